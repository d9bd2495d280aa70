"""Queries of the training-data problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.communities import clusters, describe, same_cluster_pairs
from tidemark.llm.cuts import share_cut, truncated
from tidemark.llm.leaks import leaks
from tidemark.llm.tokens import encode
from tidemark.llm.vectors import similar
from tidemark.runtime import table


def p1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, distance): the four most similar frames of every frame, of the whole collection."""
    return similar(table(spark, sf_dir, "features"), id="frame_id", vector="img", everyone=True).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.round("distance", 6).alias("distance"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_a, frame_b): those of them that are at most 1.5 apart."""
    near = similar(table(spark, sf_dir, "features"), id="frame_id", vector="img")
    return near.select(F.least("id", "other").alias("frame_a"), F.greatest("id", "other").alias("frame_b")).distinct()


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "features"), id="frame_id", group="inspection_id", vector="img")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_cluster_pairs(p4_clusters(spark, sf_dir)).select(F.col("a").alias("frame_a"), F.col("b").alias("frame_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its size, typical members, members of highest uciqe, and depth."""
    return describe(p4_clusters(spark, sf_dir), table(spark, sf_dir, "frames"), id="frame_id", quality="uciqe", depth="depth").withColumnRenamed("group", "inspection_id")


def p4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its size, its members of highest uciqe and its depth."""
    g = p4_groups(spark, sf_dir)
    return g.select("inspection_id", "cluster", "size", F.array_join("best", ",").alias("best"), *[F.round(c, 6).alias(c) for c in ("depth_mean", "depth_min", "depth_max")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), id="doc_id", text="text", item_id="item_id", item_text="text")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), id="doc_id", text="text").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents"), id="doc_id", text="text", source="source").select(F.col("id").alias("doc_id"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_cut(table(spark, sf_dir, "documents"), id="doc_id", text="text", source="source")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_edges": p1_edges, "p4_found": p4_found, "p4_groups": p4_groups, "p4_sizes": p4_sizes, "p8_found": p8_found, "p7_ids": p7_ids, "p9_found": p9_found, "p9_share": p9_share}


_IMG = "x AS (SELECT frame_id, inspection_id, any_value(img)::DOUBLE[512] AS v FROM (SELECT * FROM features WHERE len(img) = 512 AND len(list_filter(img, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0) GROUP BY 1, 2)"


def oracle_sql() -> dict[str, str]:
    """Brute force: every pair of vectors. None for p7, p8 and p9, which SQL can't express or not as plainly; see tests/llm."""
    return {
        "p1_found": f"""WITH {_IMG}, p AS (SELECT a.frame_id AS a, b.frame_id AS b, array_distance(a.v, b.v) AS d FROM x a JOIN x b ON a.frame_id <> b.frame_id),
r AS (SELECT a, b, d, rank() OVER (PARTITION BY a ORDER BY d) AS k FROM p) SELECT DISTINCT least(a, b) AS frame_a, greatest(a, b) AS frame_b FROM r WHERE k <= 4 AND d <= 1.5""",
        "p1_edges": f"""WITH {_IMG}, p AS (SELECT a.frame_id AS src, b.frame_id AS dst, array_distance(a.v, b.v) AS d FROM x a JOIN x b ON a.frame_id <> b.frame_id),
r AS (SELECT src, dst, d, rank() OVER (PARTITION BY src ORDER BY d) AS k FROM p) SELECT src, dst, round(d, 6) AS distance FROM r WHERE k <= 4""",
        "p4_sizes": f"""WITH RECURSIVE {_IMG}, p AS (SELECT a.frame_id AS a, b.frame_id AS b, a.inspection_id AS i FROM x a JOIN x b ON a.inspection_id = b.inspection_id AND array_distance(a.v, b.v) <= 1.5),
r AS (SELECT a, b, i FROM p UNION SELECT r.a, p.b, r.i FROM r JOIN p ON r.b = p.a), c AS (SELECT a AS frame_id, i AS inspection_id, min(b) AS cluster FROM r GROUP BY 1, 2),
f AS (SELECT DISTINCT frame_id, CASE WHEN NOT isnan(uciqe) THEN uciqe END AS q, CASE WHEN NOT isnan(depth) THEN depth END AS depth FROM frames), m AS (SELECT c.*, q, depth, row_number() OVER (PARTITION BY cluster ORDER BY q DESC NULLS LAST, frame_id) AS k FROM c LEFT JOIN f USING (frame_id))
SELECT inspection_id, cluster, count(*) AS size, coalesce(string_agg(frame_id, ',' ORDER BY k) FILTER (WHERE k <= 3 AND q IS NOT NULL), '') AS best, round(avg(depth), 6) AS depth_mean, round(min(depth), 6) AS depth_min, round(max(depth), 6) AS depth_max FROM m GROUP BY 1, 2 HAVING count(*) >= 5""",
        "p4_found": f"""WITH RECURSIVE {_IMG}, p AS (SELECT a.frame_id AS a, b.frame_id AS b FROM x a JOIN x b ON a.inspection_id = b.inspection_id AND array_distance(a.v, b.v) <= 1.5),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), g AS (SELECT a, count(*) AS n FROM r GROUP BY 1) SELECT a AS frame_a, b AS frame_b FROM r JOIN g USING (a) WHERE a < b AND n >= 5""",
    }
