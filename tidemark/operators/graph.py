"""Edges as tables: both directions, closures, contraction and the graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import node_id
from tidemark.model import DEPICTS
from tidemark.operators.filters import SEEN, FilterOptions, findings, of_inspections

#: Frames that a graph view shows at most; part of what the view is.
VIEW_FRAMES = 300


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge from both ends, repeats kept."""
    back = edges.withColumns({src: F.col(dst), dst: F.col(src)})
    return edges.unionByName(back)


def near_edges(edges: DataFrame, below: float, visual: bool) -> DataFrame:
    """Edges of a kind whose distance is under a threshold; null and NaN distances are not."""
    return edges.filter((F.col("visual") == visual) & (F.col("distance") < below) & ~F.isnan("distance"))


def closure(edges: DataFrame, child: str, parent: str, levels: int = 99) -> DataFrame:
    """(node, ancestor, hops) along paths of one hop or more, by a recursive query. Paths end after ``levels`` hops, so a cycle is gone round until then."""
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).filter("node is not null and up is not null").distinct()
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE c(node, ancestor, hops) AS (
            SELECT node, up, 1 FROM {{e}}
            UNION ALL SELECT c.node, e.up, c.hops + 1 FROM c JOIN {{e}} e ON c.ancestor = e.node WHERE c.hops < {int(levels)})
        SELECT node, ancestor, hops FROM c""", e=e)


def among(edges: DataFrame, nodes: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose both ends are nodes."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(n, F.col(src) == F.col("_n"), "left_semi").join(n, F.col(dst) == F.col("_n"), "left_semi")


def contract(edges: DataFrame, into: DataFrame, member: str, whole: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges after members are replaced by what they are part of; self edges may arise."""
    m = into.groupBy(F.col(member).alias("_m")).agg(F.min(whole).alias("_w"))
    for end in (src, dst):
        edges = edges.join(m, F.col(end) == F.col("_m"), "left").withColumn(end, F.coalesce("_w", end)).drop("_m", "_w")
    return edges.select(src, dst).distinct()


def simple_graph(kinds: list[tuple[DataFrame, float]]) -> DataFrame:
    """(a, b, weight), a <= b: one edge for each pair; of several kinds the later one's weight holds."""
    parts = [d.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(i).alias("_k"), F.lit(w).alias("weight")) for i, (d, w) in enumerate(kinds)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("a", "b").agg(F.max_by("weight", "_k").alias("weight"))


def base_frames(frames: DataFrame, opts: FilterOptions, limit: int = VIEW_FRAMES) -> DataFrame:
    """The first frames by their id as text that pass the filter, repeated rows once. Every part of a view is made from this.

    The ids are chosen before whole rows are taken up, so that only ids are compared and sent.
    """
    chosen = of_inspections(frames, opts).filter(findings(opts))
    ids = chosen.select("frame_id").distinct().orderBy("frame_id").limit(limit)
    return chosen.join(F.broadcast(ids), "frame_id", "left_semi").dropDuplicates(["frame_id"])


def depicts_of(frames: DataFrame) -> DataFrame:
    """(frame_id, label, vis_code, segmentation, classification): the parts that a frame's seen labels depict."""
    kinds = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(code).alias("vis_code"), F.col(x).alias("seen"), F.col(f"{x}_segmentation").alias("segmentation"), F.col(f"{x}_classification").alias("classification")) for x, code in DEPICTS.items()])
    return frames.select("frame_id", F.explode(kinds).alias("k")).select("frame_id", "k.*").filter(F.col("seen") > SEEN).drop("seen")


def neighbours(edges: list[DataFrame]) -> DataFrame:
    """(node, other): everything that any kind of edge (src, dst) leads to, in either direction, repeats kept."""
    every = undirected(edges[0].select("src", "dst"))
    for e in edges[1:]:
        every = every.unionByName(undirected(e.select("src", "dst")))
    return every.toDF("node", "other")


def view(frames: DataFrame, similar: DataFrame, in_cluster: DataFrame, clusters: DataFrame, in_mosaic: DataFrame | None, depicts: DataFrame | None, parts: DataFrame, opts: FilterOptions) -> dict[str, DataFrame]:
    """The graph view: nodes and seven sets of edges (src, dst), all over one base of frames.

    Without inspections all are empty. in_mosaic is left out unless opts.mosaics; clusters unless opts.clusters. Without ``depicts`` it is
    what the base frames' own labels depict. The base, at most 300 rows, is fetched once.
    """
    base = base_frames(frames, opts)
    base = base.sparkSession.createDataFrame(base.collect(), base.schema)
    depicts = depicts_of(base) if depicts is None else depicts
    ids = base.select("frame_id")
    f = lambda c: node_id("im", c)

    def similar_of(visual: bool, below: float) -> DataFrame:
        both = undirected(near_edges(similar, below, visual))
        return both.join(F.broadcast(ids), F.col("src") == F.col("frame_id"), "left_semi").select(f("src").alias("src"), f("dst").alias("dst")).distinct()

    pairs = lambda a, b: base.sparkSession.createDataFrame([], "src string, dst string")  # noqa: E731, ARG005
    cl = pairs(0, 0)
    if opts.clusters:
        cl = in_cluster.join(F.broadcast(ids), "frame_id", "left_semi").join(clusters.filter("number <> -1").select("cluster_id"), "cluster_id").select(f("frame_id").alias("src"), node_id("c", "cluster_id").alias("dst")).distinct()
    mo = pairs(0, 0)
    if opts.mosaics and in_mosaic is not None:
        mo = in_mosaic.join(F.broadcast(ids), "frame_id", "left_semi").select(f("frame_id").alias("src"), node_id("m", "mosaic_id").alias("dst")).distinct()
    shows = depicts.join(F.broadcast(base.select("frame_id", "imo")), "frame_id").join(parts.select("vis_code").distinct(), "vis_code")
    return {
        "nodes": base.select(f("frame_id").alias("id"), F.to_json(F.struct("*")).alias("data")),
        "similar_to": similar_of(False, opts.telemetry_similarities),
        "visually_similar_to": similar_of(True, opts.visual_similarities),
        "in_inspection": base.select(f("frame_id").alias("src"), node_id("in", "inspection_id").alias("dst")).distinct(),
        "in_mosaic": mo,
        "in_cluster": cl,
        "shows_part": shows.select(f("frame_id").alias("src"), node_id("p_s", "imo", "vis_code").alias("dst")).distinct(),
        "part_of_ship": shows.select(node_id("p_s", "imo", "vis_code").alias("src"), node_id("s", "imo").alias("dst")).distinct(),
    }


def member_quality(members: DataFrame, whole: str, quality: str) -> DataFrame:
    """Each member with the mean quality of its whole."""
    return members.withColumn("avg_quality", F.avg(quality).over(W.partitionBy(whole)))
