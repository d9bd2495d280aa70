"""Exact neighbours within groups: k nearest, pairs within a distance, and density clusters.

Scale. A group of more than ``block`` rows is split into blocks by a hash of the id, and tasks are pairs of blocks; so
the largest group takes many tasks of bounded size, and a row is sent once for each block of its own group. Tasks
multiply matrices and keep only what can still matter: the k nearest of each row, degrees, or a star for each piece.

Defined results. Rows with a null id, group or vector, or with a null or non-finite element take no part; a repeated id
counts once. Vectors of unequal length within a group raise. Ties among the k nearest go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.components import connected, pieces
from tidemark.runtime import cut, map_segments


def _tasks(df: DataFrame, id: str, group: str, vector: str, block: int, *more: str) -> DataFrame:
    """(group, a, b, side, id, v, more): rows in the pairs of blocks of their group."""
    rows = df.select(F.col(id).alias("id"), F.col(group).alias("group"), F.col(vector).cast("array<double>").alias("v"), *more).filter("id is not null and `group` is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).dropDuplicates(["id"])
    blocks = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    r = rows.join(blocks, "group").withColumn("_o", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least(k, F.col("_o")).alias("a"), F.greatest(k, F.col("_o")).alias("b"), (F.col("_o") > k).cast("int").alias("side")))
    return r.withColumn("_p", F.explode(pairs)).select("group", "_p.a", "_p.b", "_p.side", "id", "v", *more)


def _pairwise(tasks: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, bool], pd.DataFrame | None], schema: str) -> DataFrame:
    """fn(left rows, right rows, distances, one block): for each pair of blocks. The distance of a row to itself is infinite."""
    def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            part = batch.iloc[s:e]
            one = part.a.iloc[0] == part.b.iloc[0]
            left = part[part.side == 0]
            right = left if one else part[part.side == 1]
            if not len(left) or not len(right):
                continue
            x = np.stack(left.v.to_numpy())
            y = x if one else np.stack(right.v.to_numpy())
            step = max(1, 4_000_000 // len(y))
            for lo in range(0, len(x), step):
                q = x[lo : lo + step]
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * q @ y.T, 0))
                near = d < 1e-3 * (1 + np.sqrt((q * q).sum(1)))[:, None]  # products lose small distances
                i, j = np.nonzero(near)
                d[i, j] = np.sqrt(((q[i] - y[j]) ** 2).sum(1))
                if one:
                    d[np.arange(len(q)), lo + np.arange(len(q))] = np.inf
                r = fn(left.iloc[lo : lo + step], right, d, one)
                if r is not None:
                    out.append(r)
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0].strip("`"): [] for c in schema.split(", ")}, dtype=object)

    return map_segments(tasks, ["group", "a", "b"], ["side", "id"], work, schema)


def k_nearest(df: DataFrame, *, id: str, group: str, vector: str, k: int = 4, block: int = 2048) -> DataFrame:
    """(src, dst, distance, rank): the k nearest others of each row within its group."""
    kind = {c: t for c, t in df.dtypes}[id]

    def directed(of: pd.DataFrame, to: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        n = min(k, d.shape[1])
        kth = np.partition(d, n - 1, axis=1)[:, n - 1] * (1 + 1e-9)
        i, j = np.nonzero((d <= kth[:, None]) & np.isfinite(d))  # ties are kept until the last rank
        x, y = np.stack(of.v.to_numpy()), np.stack(to.v.to_numpy())
        exact = [np.sqrt(((x[i[p : p + 20_000]] - y[j[p : p + 20_000]]) ** 2).sum(1)) for p in range(0, len(i), 20_000)]
        return pd.DataFrame({"src": of.id.to_numpy()[i], "dst": to.id.to_numpy()[j], "distance": np.concatenate(exact) if exact else np.empty(0)})

    def fn(left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray, one: bool) -> pd.DataFrame:
        return directed(left, right, d) if one else pd.concat([directed(left, right, d), directed(right, left, d.T)])

    near = _pairwise(_tasks(df, id, group, vector, block), fn, f"src {kind}, dst {kind}, distance double")
    w = W.partitionBy("src").orderBy(F.round("distance", 9), "dst")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def density_clusters(df: DataFrame, *, id: str, group: str, vector: str, eps: float, least: int = 5, block: int = 2048) -> DataFrame:
    """(id, group, core, number): density clusters within groups; number counts clusters by their least core id, -1 is noise.

    A row is core if at least ``least`` rows, itself among them, are at most ``eps`` away. Cores within eps are one cluster;
    another row belongs to the lowest-numbered cluster that has a core within eps.
    """
    kind, gkind = dict(df.dtypes)[id], dict(df.dtypes)[group]

    def degrees(left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray, one: bool) -> pd.DataFrame:
        within = d <= eps
        out = [pd.DataFrame({"u": left.id, "n": within.sum(1)})]
        return out[0] if one else pd.concat([out[0], pd.DataFrame({"u": right.id, "n": within.sum(0)})])

    rows = df.select(F.col(id).alias("id"), F.col(group).alias("group"), F.col(vector).alias("v"))
    n = _pairwise(_tasks(rows, "id", "group", "v", block), degrees, f"u {kind}, n bigint").groupBy("u").agg((F.sum("n") + 1 >= least).alias("core"))
    flagged = cut(rows.dropDuplicates(["id"]).join(n.withColumnRenamed("u", "id"), "id"))

    def links(left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray, one: bool) -> pd.DataFrame | None:
        lc, rc = left.core.to_numpy(bool), right.core.to_numpy(bool)
        i, j = np.nonzero((d <= eps) & (lc[:, None] | rc[None]))
        if not len(i):
            return None
        a, b = left.id.to_numpy(), right.id.to_numpy()
        both = lc[i] & rc[j]
        names, at = np.unique(np.r_[a, b].astype(object), return_inverse=True)
        root = names[pieces(len(names), at[: len(a)][i[both]], at[len(a) :][j[both]])]
        of_left, of_right = root[at[: len(a)]], root[at[len(a) :]]
        edge = ~both
        core_first = lc[i[edge]]
        border = np.where(core_first, b[j[edge]], a[i[edge]])
        to = np.where(core_first, of_left[i[edge]], of_right[j[edge]])
        stars = pd.concat([pd.DataFrame({"u": a[lc], "v": of_left[lc]}), pd.DataFrame({"u": b[rc], "v": of_right[rc]})]).drop_duplicates().assign(border=False)
        return pd.concat([stars, pd.DataFrame({"u": border, "v": to, "border": True}).drop_duplicates()])

    found = cut(_pairwise(_tasks(flagged, "id", "group", "v", block, "core"), links, f"u {kind}, v {kind}, border boolean"))
    label = connected(found.filter("not border").select("u", "v"))
    cores = flagged.filter("core").select("id", "group").join(label.withColumnRenamed("u", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    numbered = cores.select("group", "label").distinct().withColumn("number", F.row_number().over(W.partitionBy("group").orderBy("label")) - 1)
    cores = cores.join(numbered, ["group", "label"])
    edge = found.filter("border").select(F.col("u").alias("b"), F.col("v").alias("id")).join(cores.select("id", "number"), "id").groupBy(F.col("b").alias("id")).agg(F.min("number").alias("_e"))
    out = flagged.select("id", "group", "core").join(cores.select("id", "number"), "id", "left").join(edge, "id", "left")
    return out.select("id", "group", "core", F.coalesce("number", "_e", F.lit(-1)).cast("int").alias("number"))


def cluster_nodes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clusters' nodes (cluster_id, inspection_id, number), noise included, and the members' edges (frame_id, cluster_id)."""
    c = found.withColumn("cluster_id", F.concat(F.lit("c"), F.col("group").cast("string"), F.lit("."), F.col("number").cast("string")))
    return c.select("cluster_id", F.col("group").alias("inspection_id"), "number").distinct(), c.select(F.col("id").alias("frame_id"), "cluster_id").distinct()
