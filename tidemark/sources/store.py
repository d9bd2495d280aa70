"""Sources and sinks of the graph: files, keyed upserts, cascading deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import detid
from tidemark.model import SCHEMAS


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, telemetry): videos at any depth that have a telemetry file beside them, by path. A missing path raises."""
    def files(ending: str) -> DataFrame:
        f = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", "true").load(path)
        return f.select("path", F.col("length").alias("size"), F.regexp_replace("path", rf"\{ending}$", "").alias("stem"))

    return files(".mp4").join(files(".ass").select("stem", F.col("path").alias("telemetry")), "stem").select("path", "size", "telemetry").orderBy("path")


def overlay_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, event_no, start_ms, text) of subtitle files, for ``overlay.instants``. Lines that are no event are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    e = lines.filter(F.col("value").startswith("Dialogue:")).withColumn("p", F.split(F.expr("substring(value, 10)"), ",", 10)).filter(F.size("p") == 10)
    t = F.split(F.trim(F.col("p")[1]), "[:.]")
    ms = ((t[0].cast("long") * 60 + t[1].cast("long")) * 60 + t[2].cast("long")) * 1000 + t[3].cast("long") * 10
    return e.select("file", F.col("line").cast("int").alias("event_no"), ms.alias("start_ms"), F.col("p")[9].alias("text"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar JSON with ids, and ``missing``: the fields that are absent or say unknown."""
    d = spark.read.schema(SCHEMAS["metadata"]).option("multiLine", "true").json(path)
    gap = [F.when(F.col(c).isNull() | (F.lower(c) == "unknown"), F.lit(c)) for c in d.columns]
    return d.withColumn("missing", F.filter(F.array(*gap), lambda x: x.isNotNull())).withColumn("ship_id", detid("ship_name")).withColumn("inspection_id", detid(F.concat("imo", "inspection_date")))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], *, update: bool = False, fail_on_exists: bool = False) -> DataFrame:
    """Target with the new rows added. Existing keys are kept, or overwritten with ``update``; or raise when evaluated.

    Repeated keys among the new rows count once; which of differing rows stays is not defined.
    """
    keys = list(keys)
    new = new.dropDuplicates(keys)
    if fail_on_exists:
        known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
        new = new.join(known, keys, "left").filter(F.when(F.col("_known"), F.raise_error(F.lit("the key exists")).cast("boolean")).otherwise(F.lit(True))).drop("_known")
        return target.unionByName(new)
    if update:
        return target.join(new.select(*keys), keys, "left_anti").unionByName(new)
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti"))


def checked(rows: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """The rows; raises when evaluated if one has no parent, or several."""
    p = parent.groupBy(F.col(parent_key or key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    fine = F.when(F.coalesce("_n", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{key} has not one parent: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return rows.join(p, F.col(key) == F.col("_k"), "left").filter(fine).drop("_k", "_n")


def delete_inspections(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the inspections of ``gone`` (inspection_id), their frames, and what hangs on those."""
    t = dict(tables)
    frames = t["frames"].join(gone, "inspection_id", "left_semi").select("frame_id").distinct()
    for name in ("inspections", "frames", "clusters"):
        if name in t:
            t[name] = t[name].join(gone, "inspection_id", "left_anti")
    for name in ("in_cluster", "in_mosaic", "depicts"):
        if name in t:
            t[name] = t[name].join(frames, "frame_id", "left_anti")
    if "similar" in t:
        for end in ("src", "dst"):
            t["similar"] = t["similar"].join(frames.withColumnRenamed("frame_id", end), end, "left_anti")
    if "mosaics" in t and "in_mosaic" in tables:
        lost = tables["in_mosaic"].join(frames, "frame_id", "left_semi").select("mosaic_id").distinct()
        t["mosaics"] = t["mosaics"].join(lost, "mosaic_id", "left_anti")
    return t


def delete_similarities(similar: DataFrame, frames: DataFrame, inspections: Sequence[int] | None = None) -> DataFrame:
    """Similarities without those that begin at a frame of the inspections; None deletes all."""
    if inspections is None:
        return similar.limit(0)
    own = frames.filter(F.col("inspection_id").isin(*inspections) if inspections else F.lit(False)).select(F.col("frame_id").alias("src")).distinct()
    return similar.join(own, "src", "left_anti")


def delete_context(tables: dict[str, DataFrame], inspections: Sequence[int] | None = None) -> dict[str, DataFrame]:
    """``similar``, ``clusters`` and ``in_cluster`` without what enrichment made of the inspections; None deletes all of it.

    A cluster goes with all its members' edges if any member is a frame of the inspections.
    """
    t = dict(tables)
    if inspections is None:
        return t | {n: t[n].limit(0) for n in ("similar", "clusters", "in_cluster")}
    own = t["frames"].filter(F.col("inspection_id").isin(*inspections) if inspections else F.lit(False)).select("frame_id").distinct()
    gone = t["in_cluster"].join(own, "frame_id", "left_semi").select("cluster_id").distinct()
    return t | {"similar": delete_similarities(t["similar"], t["frames"], inspections)} | {n: t[n].join(gone, "cluster_id", "left_anti") for n in ("clusters", "in_cluster")}


def missing(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not there yet, each key once: what is left to be computed and appended."""
    return wanted.dropDuplicates(list(keys)).join(have.select(*keys), list(keys), "left_anti")


def attach(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones, each once."""
    return edges.unionByName(new).distinct()


def save_all(tables: dict[str, DataFrame], out: str) -> None:
    """Write several tables as one: all to a folder of their own first, which takes its place only when it is whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/_new/{name}.parquet")
    for name in tables:
        spark.read.parquet(f"{out}/_new/{name}.parquet").write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def save(df: DataFrame, path: str, *, mode: str = "append", by: Sequence[str] = ()) -> None:
    """Write as Parquet; the job commits whole or not at all. Reading and overwriting the same path isn't possible."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def save_statistics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
