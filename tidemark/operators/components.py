"""Connected components, in one array and over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut


def pieces(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connected pieces: for each node the least node of its piece."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, label): the least node connected to each node of ``edges`` (u, v), by alternating star contractions."""
    nodes = cut(edges.select("u").union(edges.select("v")).distinct())
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    for _ in range(rounds):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = cut(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("star contraction did not end")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("l")), "u", "left").select("u", F.coalesce("l", "u").alias("label"))
