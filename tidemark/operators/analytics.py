"""Tables, histograms and drill-downs over frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import growth_ratio, heading_bin
from tidemark.model import DEFECTS, LABELS
from tidemark.operators.filters import SEEN, FilterOptions, findings, of_inspections


def count_seen(label: str) -> Column:
    """How many rows a label is seen in; null counts as not seen."""
    return F.sum(F.when(F.col(label) > SEEN, 1).otherwise(0)).alias(label)


def defect_table(frames: DataFrame, keys: Sequence[str], labels: Sequence[str] = DEFECTS) -> DataFrame:
    return frames.groupBy(*keys).agg(*[count_seen(x) for x in labels])


def by_ship(frames: DataFrame, inspections: DataFrame, ships: DataFrame, labels: Sequence[str] = DEFECTS) -> DataFrame:
    """(name, imo, labels): defects for each ship, by the ship of the frame's inspection. Inspections of unknown ships are left out."""
    of = inspections.select("inspection_id", "imo").distinct().join(ships.select("imo", "name").distinct(), "imo")
    return defect_table(frames.drop("imo").join(of, "inspection_id"), ["name", "imo"], labels)


def by_part(frames: DataFrame, depicts: DataFrame, parts: DataFrame | None = None, labels: Sequence[str] = DEFECTS) -> DataFrame:
    """Defects for each part by its code or, with ``parts`` (vis_code, name), by its name over all ships; a frame counts once for each part that it shows."""
    shown, key = depicts.select("frame_id", "vis_code").distinct(), "vis_code"
    if parts is not None:
        shown, key = shown.join(parts.select("vis_code", "name").distinct(), "vis_code"), "name"
    return defect_table(frames.join(shown, "frame_id"), [key], labels)


def heading_histogram(frames: DataFrame, inspections: DataFrame, *, faithful: bool = False) -> DataFrame:
    """(inspection_id, imo, date, ship_heading, heading, count)."""
    f = frames.select("inspection_id", "heading").filter("heading is not null and not isnan(heading)")
    i = inspections.select("inspection_id", "imo", "date", F.when(~F.isnan("ship_heading"), F.col("ship_heading")).alias("ship_heading"))
    j = f.join(i, "inspection_id").withColumn("heading", heading_bin("heading", "ship_heading", faithful=faithful))
    return j.groupBy("inspection_id", "imo", "date", "ship_heading", "heading").agg(F.count(F.lit(1)).alias("count"))


def nested_headings(histogram: DataFrame) -> DataFrame:
    """One row for each inspection, its bins in an array by heading; at most 12 (24 in the faithful form)."""
    return histogram.groupBy("inspection_id", "imo", "date", "ship_heading").agg(F.array_sort(F.collect_list(F.struct("heading", "count"))).alias("data"))


def keywords(counts: dict[str, Column], size: Column) -> Column:
    """Labels seen in more than a third (rounded down) of a cluster, in fixed order, separated by spaces."""
    names = F.array(*[F.when(c > F.floor(size / 3), F.lit(x)) for x, c in counts.items()])
    return F.array_join(F.filter(names, lambda x: x.isNotNull()), " ")


def cluster_table(frames: DataFrame, in_cluster: DataFrame, clusters: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(inspection_id, cluster, size, first_frame, key_frame, keywords), noise left out.

    The key frame is the one of highest quality, of equal ones that of the highest frame number and then id; '' where no
    member has a quality of 0 or more.
    """
    c = clusters.filter("number <> -1").select("cluster_id", "inspection_id", F.col("number").alias("cluster")).distinct()
    m = in_cluster.distinct().join(c, "cluster_id").join(frames.drop("inspection_id"), "frame_id")
    fit = (F.col("uciqe") >= 0) & ~F.isnan("uciqe")
    g = m.groupBy("inspection_id", "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min("framenumber").alias("first_frame"),
        F.max(F.when(fit, F.struct("uciqe", "framenumber", "frame_id", "thumbnail")))["thumbnail"].alias("_key"), *[count_seen(x) for x in labels])
    return g.select("inspection_id", "cluster", "size", "first_frame", F.coalesce("_key", F.lit("")).alias("key_frame"), keywords({x: F.col(x) for x in labels}, F.col("size")).alias("keywords"))


def sector_frames(frames: DataFrame, inspections: DataFrame, opts: FilterOptions, in_mosaic: DataFrame | None = None) -> DataFrame:
    """(inspection_id, heading, path, uciqe) of the frames of every sector; with mosaics, the mosaic's id where there is one."""
    f = of_inspections(frames, opts).filter(findings(opts)).filter("heading is not null and not isnan(heading)")
    f = f.join(inspections.select("inspection_id", F.when(~F.isnan("ship_heading"), F.col("ship_heading")).alias("ship_heading")).distinct(), "inspection_id")
    path = F.col("thumbnail")
    if opts.mosaics and in_mosaic is not None:
        f = f.join(in_mosaic.select("frame_id", "mosaic_id"), "frame_id", "left")
        path = F.coalesce("mosaic_id", "thumbnail")
    return f.select("inspection_id", heading_bin("heading", "ship_heading").alias("heading"), path.alias("path"), "uciqe").distinct()


def frames_of_sector(frames: DataFrame, inspections: DataFrame, inspection_id: int, heading: int, opts: FilterOptions, in_mosaic: DataFrame | None = None) -> DataFrame:
    """(path, uciqe) of the frames of one sector of one inspection, best first."""
    s = sector_frames(frames.filter(F.col("inspection_id") == inspection_id), inspections, opts, in_mosaic)
    return s.filter(F.col("heading") == heading).select("path", "uciqe").orderBy(F.desc_nulls_first("uciqe"))


def cluster_frames(frames: DataFrame, in_cluster: DataFrame) -> DataFrame:
    """(cluster_id, path, uciqe, framenumber) of the frames of every cluster; a NaN quality is null."""
    f = frames.select("frame_id", F.col("thumbnail").alias("path"), F.when(~F.isnan("uciqe"), F.col("uciqe")).alias("uciqe"), "framenumber")
    return f.join(in_cluster.select("frame_id", "cluster_id").distinct(), "frame_id").select("cluster_id", "path", "uciqe", "framenumber")


def frames_of_cluster(frames: DataFrame, in_cluster: DataFrame, cluster_id: str) -> DataFrame:
    """(path, uciqe, framenumber) of one cluster, in the order of the frames."""
    return cluster_frames(frames, in_cluster.filter(F.col("cluster_id") == cluster_id)).drop("cluster_id").orderBy(F.asc_nulls_last("framenumber"))


def mosaic_growth(frames: DataFrame, in_mosaic: DataFrame, mosaics: DataFrame, opts: FilterOptions) -> DataFrame:
    """(mosaic_id, growth): percentage of the hull that is grown over, for each mosaic that a chosen frame is in (quality ignored)."""
    f = of_inspections(frames, opts).filter(findings(opts, ignore_quality=True)).select("frame_id")
    m = in_mosaic.join(f, "frame_id", "left_semi").select("mosaic_id").distinct()
    return mosaics.join(m, "mosaic_id", "left_semi").select("mosaic_id", growth_ratio("marine_growth_percentage", "ship_hull_percentage").alias("growth")).distinct()


def value_histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, count) of the finite values; bin is the lower edge."""
    v = F.col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy((F.floor(v / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def histogram_values(frames: DataFrame, similar: DataFrame, opts: FilterOptions, in_mosaic: DataFrame | None = None, mosaics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Raw values of the chosen frames (quality ignored), the growth of their mosaics, and the distances of their edges, once from each matching end."""
    from tidemark.operators.graph import undirected

    f = of_inspections(frames, opts).filter(findings(opts, ignore_quality=True))
    ids = f.select(F.col("frame_id").alias("src"))
    edges = undirected(similar).join(ids, "src", "left_semi")
    growth = {} if in_mosaic is None or mosaics is None else {"growth": mosaic_growth(frames, in_mosaic, mosaics, opts).select("growth")}
    return growth | {
        "uciqe": f.select("uciqe"), "depth": f.select("depth"),
        "similar": edges.filter("not visual").select("distance"), "visually_similar": edges.filter("visual").select("distance"),
    }


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, sample deviation and variance, count; deviation of a single value is null."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("stdev"), F.var_samp(v).alias("variance"), F.count(v).alias("samples"))


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; none and several can't be told apart by a lookup."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return df.join(once, list(keys), "left_semi")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key by an order; every task cuts its rows to k before they are sent."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")
