"""Clusters of mutually similar vectors within groups, described by size and typical members.

Method. Within a group (an inspection) an approximate nearest-neighbour graph is built by neighbour descent: random
neighbours are improved by the neighbours of neighbours until hardly any changes. The distance of the k-th found bounds
a scan that completes the lists, so that they are the k nearest (of equally near ones those of the least id). The edges of at most
``reach``, weighted by closeness, are divided into communities by modularity (local moves, then moves of whole
communities); members are described by their weighted degree inside their community. Communities that an edge connects make a
piece. An exact check follows: pieces are joined wherever two communities of theirs, told apart by their centres and radii first,
have vectors at most ``reach`` apart. So a cluster is exactly what chains of steps of at most ``reach`` connect, and the
communities are its parts. ``describe`` says how many pieces each cluster had before the check, so that its share is seen.

Local moves are made in rounds, each by the half of the nodes whose id's hash says so, all at once, so that neighbours
seldom change places. Weights are whole numbers, so that sums don't depend on their order: one task and many come
to the same communities.

Scale. Groups of at most ``whole`` vectors are worked on in one task each, many to a batch. Larger ones have
all near pairs found by the partitioned scan of ``vectors``, where every task reduces its pairs to a star for each piece
and to the k nearest of each vector. The stars are joined to clusters by alternating star contractions, cut by reliable
checkpoints; the k nearest are the graph. A node's moves depend on its cluster alone and on the group's whole weight, so
clusters of few edges are divided in one task each, and the rest by the same rounds as joins.

Defined results. Vectors that are null, not of the given length or not finite, and rows with a null id or group take no
part. A repeated id counts once. Clusters under ``least`` members are noise. Nothing depends on row order or on ``whole``; a
community is named by its cluster and its least id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.vectors import DIMENSIONS, Met, met_in, met_in_tables, one_of_each, packed_rows, planned, ranges, usable
from tidemark.operators.components import connected, pieces
from tidemark.runtime import cut, map_segments

ROUNDS = 16  # of moves at one level
UNIT = 1e6  # weights are whole multiples of one in so many
LEAST_GAIN = 1e-6
BUCKETS = 64  # parts in which a cluster is described


def neighbour_descent(x: np.ndarray, k: int, seed: int = 1, rounds: int = 12, enough: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, distances), each (n, k): approximately the k nearest others of each row, nearest first."""
    n = len(x)
    k = min(k, n - 1)
    sq = (x * x).sum(1)
    if n <= 4 * k + 4:  # neighbours of neighbours are everyone
        d = sq[:, None] + sq[None] - 2 * x @ x.T
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        return near, np.sqrt(np.maximum(np.take_along_axis(d, near, 1), 0))
    rng = np.random.default_rng(seed)
    near = np.sort((np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, k))) % n, axis=1)
    dist = ((x[near] - x[:, None]) ** 2).sum(2)
    for _ in range(rounds):
        # candidates: neighbours of neighbours, and of some who have this one as a neighbour
        back = np.full((n, k), -1)
        order = np.argsort(near.ravel(), kind="stable")
        to, of = near.ravel()[order], np.repeat(np.arange(n), k)[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        back[to[place < k], place[place < k]] = of[place < k]
        both = np.concatenate([near, np.where(back < 0, near, back)], 1)
        changed = 0
        for lo in range(0, n, 256):
            rows = np.arange(lo, min(lo + 256, n))
            cand = np.concatenate([near[rows], both[both[rows]].reshape(len(rows), -1)], 1)
            cand = np.sort(cand, axis=1)
            dup = np.c_[np.zeros(len(rows), bool), cand[:, 1:] == cand[:, :-1]] | (cand == rows[:, None])
            d = np.empty(cand.shape)
            for i, r in enumerate(rows):
                d[i] = sq[cand[i]] - 2 * x[cand[i]] @ x[r] + sq[r]
            d[dup] = np.inf
            pick = np.argsort(d, axis=1, kind="stable")[:, :k]
            new, nd = np.take_along_axis(cand, pick, 1), np.take_along_axis(d, pick, 1)
            worse = np.isinf(nd)
            new, nd = np.where(worse, near[rows], new), np.where(worse, dist[rows], nd)
            changed += (np.sort(new, 1) != np.sort(near[rows], 1)).sum()
            near[rows], dist[rows] = new, nd
        if changed <= enough * n * k:
            break
    o = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(near, o, 1), np.sqrt(np.maximum(np.take_along_axis(dist, o, 1), 0))


def modularity_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, passes: int = 10, total: float | np.ndarray | None = None, hashes: np.ndarray | None = None) -> np.ndarray:
    """The least node of its community for each of n nodes, by moves that raise modularity, on ever coarser graphs. Edges once each.

    total: the sum of all degrees, of each node's graph if there are several; that of these edges if not given.
    hashes: 64 bits for each node, which say in what rounds it may move.
    """
    label = np.arange(n)
    hashes = pd.util.hash_array(label).view(np.int64) if hashes is None else hashes
    m = np.broadcast_to(np.asarray(2 * w.sum() if total is None else total, float), n)
    for _ in range(passes):
        if not len(a):
            break
        own = _moves(n, a, b, w, m, hashes)
        if (own == np.arange(n)).all():
            break
        label = own[label]
        ends, at = np.unique(np.minimum(own[a], own[b]) * n + np.maximum(own[a], own[b]), return_inverse=True)
        a, b, w = ends // n, ends % n, np.bincount(at, w)
    return label


def _moves(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, m: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One level of local moves: for each node the least node of the community that it comes to."""
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    apart = a != b
    u, v, x = np.r_[a[apart], b[apart]], np.r_[b[apart], a[apart]], np.r_[w[apart], w[apart]]
    own = np.arange(n)
    for r in range(ROUNDS):
        weight = np.bincount(own, degree, n)
        key, at = np.unique(u * n + own[v], return_inverse=True)
        of, to, by = key // n, key % n, np.bincount(at, x)
        here = np.zeros(n)
        home = to == own[of]
        here[of[home]] = by[home]
        stay = here - degree * (weight[own] - degree) / m
        gain = by - degree[of] * weight[to] / m[of]
        ok = np.flatnonzero((to != own[of]) & (gain > stay[of] + LEAST_GAIN))
        if not len(ok):
            break
        ok = ok[np.lexsort((to[ok], -gain[ok], of[ok]))]
        ok = ok[np.r_[True, of[ok][1:] != of[ok][:-1]]]
        ok = ok[(hashes[of[ok]] >> r) & 1 == 0]
        own[of[ok]] = to[ok]
    low = np.full(n, n)
    np.minimum.at(low, own, np.arange(n))
    return low[own]


def nearest(x: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance): the k nearest others of each row that are at most ``reach`` away, of equal ones the first rows."""
    n = len(x)
    wide = x.astype(np.float64)
    c = wide - wide.mean(0)
    near, dist = neighbour_descent(c, k)
    s = np.sort(near, 1)
    bound = np.where((s[:, 1:] == s[:, :-1]).any(1), reach, np.minimum(dist[:, -1], reach))
    copy = pd.Series(pd.factorize(np.array([v.tobytes() for v in x], dtype=object))[0])
    cols = np.flatnonzero(copy.groupby(copy).cumcount().to_numpy() <= k)  # further copies are never among the first
    sq = (c * c).sum(1)
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for lo in range(0, n, 256):
        d = sq[lo : lo + 256, None] + sq[cols][None] - 2 * c[lo : lo + 256] @ c[cols].T
        i, j = np.nonzero(d <= (bound[lo : lo + 256, None] + 1e-3) ** 2 + 1e-3)
        i, j = i + lo, cols[j]
        i, j = i[i != j], j[i != j]
        e = np.concatenate([np.sqrt(((wide[i[p : p + 20_000]] - wide[j[p : p + 20_000]]) ** 2).sum(1)) for p in range(0, len(i), 20_000)] or [np.empty(0)])
        first = _first(i, j, e, k)
        first = first[e[first] <= reach]
        out.append((i[first], j[first], e[first]))
    return tuple(np.concatenate([o[p] for o in out]) for p in range(3))


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each i, of equal ones the least j."""
    o = np.lexsort((j, d, i))
    new = np.flatnonzero(np.r_[True, i[o][1:] != i[o][:-1]]) if len(o) else o
    return o[np.arange(len(o)) - np.repeat(new, np.diff(np.r_[new, len(o)])) < k]


def clusters_of(x: np.ndarray, reach: float, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, piece, community, weighted degree within the community) of each row of one group; all named by their least row."""
    n = len(x)
    if n == 1:
        return np.zeros(1, int), np.zeros(1, int), np.zeros(1, int), np.zeros(1)
    i, j, d = nearest(x, k, reach)
    _, one = np.unique(np.minimum(i, j) * n + np.maximum(i, j), return_index=True)
    a, b, w = np.minimum(i, j)[one], np.maximum(i, j)[one], np.rint(UNIT / (0.05 * reach + d[one]))
    community = modularity_communities(n, a, b, w, hashes=hashes)
    inside = community[a] == community[b]
    degree = (np.bincount(a[inside], w[inside], n) + np.bincount(b[inside], w[inside], n)) / UNIT
    piece = pieces(n, np.r_[np.arange(n), a[~inside]], np.r_[community, b[~inside]])
    more = _joins(x.astype(np.float64), community, piece, reach)
    cluster = pieces(n, np.r_[np.arange(n), more[:, 0]], np.r_[piece, more[:, 1]]) if len(more) else piece
    return cluster, piece, community, degree


def _joins(x: np.ndarray, community: np.ndarray, piece: np.ndarray, reach: float) -> np.ndarray:
    """A pair of rows for every two communities of different pieces that lie within reach of each other."""
    names, at = np.unique(community, return_inverse=True)
    own = piece[names]
    if (own == own[0]).all():
        return np.empty((0, 2), int)
    count = np.bincount(at)
    centre = np.zeros((len(names), x.shape[1]))
    np.add.at(centre, at, x)
    centre /= count[:, None]
    radius = np.zeros(len(names))
    np.maximum.at(radius, at, np.sqrt(((x - centre[at]) ** 2).sum(1)))
    sq = (centre * centre).sum(1)
    out = []
    order = np.argsort(at, kind="stable")
    start = np.r_[0, np.cumsum(count)]
    for lo in range(0, len(names), 512):
        gap = np.sqrt(np.maximum(sq[lo : lo + 512, None] + sq[None] - 2 * centre[lo : lo + 512] @ centre.T, 0))
        p, q = np.nonzero((gap <= radius[lo : lo + 512, None] + radius[None] + reach + 1e-6) & (own[lo : lo + 512, None] != own[None]))
        for u, v in zip((p + lo).tolist(), q.tolist(), strict=True):
            if u < v:
                r, s = order[start[u] : start[u + 1]], order[start[v] : start[v + 1]]
                for k in range(0, len(r), 512):
                    d = ((x[r[k : k + 512]] ** 2).sum(1)[:, None] + (x[s] ** 2).sum(1)[None] - 2 * x[r[k : k + 512]] @ x[s].T)
                    y, z = np.nonzero(d <= reach * reach + 1e-3)
                    exact = ((x[r[k + y]] - x[s[z]]) ** 2).sum(1) <= reach * reach if len(y) else np.empty(0, bool)
                    if exact.any():
                        out.append((r[k + y[exact][0]], s[z[exact][0]]))
                        break
    return np.array(out, dtype=int).reshape(-1, 2)


def clusters(df: DataFrame, *, id: str, group: str, vector: str, reach: float = 1.5, k: int = 8, dimensions: int = DIMENSIONS, whole: int = 4096) -> DataFrame:
    """(id, group, cluster, piece, community, degree): cluster is the least id of the cluster's members, piece that of its piece. See the module's text."""
    rows = usable(df.filter(F.col(group).isNotNull()), id, vector, dimensions, F.col(group).alias("group"))
    rows = rows.dropDuplicates(["id"])
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, `group` {kinds['group']}, cluster {kinds['id']}, piece {kinds['id']}, community string, degree double"
    large = cut(rows.groupBy("group").count().filter(F.col("count") > whole).select("group"))

    def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids = batch.id.to_numpy()
        least, part, community, degree = *(np.empty(len(batch), dtype=object) for _ in range(3)), np.zeros(len(batch))
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            x = np.stack(batch.v.iloc[s:e].to_numpy())
            cluster, piece, com, degree[s:e] = clusters_of(x, reach, k, batch["hash"].to_numpy()[s:e])
            own = ids[s:e]
            least[s:e], part[s:e] = own[cluster], own[piece]  # rows are sorted by id, so the least row is the least id
            community[s:e] = np.char.add(np.char.add(own[cluster].astype(str), "/"), own[com].astype(str))
        return pd.DataFrame({"id": ids, "group": batch.group, "cluster": least, "piece": part, "community": community, "degree": degree})

    small = rows.join(large, "group", "left_anti") if not large.isEmpty() else rows
    out = map_segments(small.select("group", "id", "v", F.xxhash64("id").alias("hash")), ["group"], ["id"], work, schema)
    if large.isEmpty():
        return out
    return out.unionByName(_large(rows.join(large, "group", "left_semi"), reach, k, dimensions, whole))


def _large(rows: DataFrame, reach: float, k: int, dimensions: int, whole: int) -> DataFrame:
    n = rows.count()
    plan = planned(rows.select("id", "v"), n, reach=reach, sample=8_192, leaf=512, loss=1e-6)
    shared = rows.sparkSession.sparkContext.broadcast(plan)
    kind = dict(rows.dtypes)["id"]

    def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = [pd.DataFrame({"u": pd.Series([], dtype=object), "v": pd.Series([], dtype=object), "d": pd.Series([], dtype=float)})]
        ids, group = batch.id.to_numpy(), batch.group.to_numpy()
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            i, j, d = _met_pairs(met_in(batch, s, e, shared.value, reach, "group"), k)
            i, j = i - s, j - s
            same = group[s + i] == group[s + j]
            i, j, d = i[same], j[same], d[same]
            root = pieces(e - s, i, j)
            rank = np.argsort(np.argsort(ids[s:e]))  # name pieces by their least id
            low = np.full(e - s, e - s)
            np.minimum.at(low, root, rank)
            name = ids[s:e][np.argsort(rank)][low[root]]
            apart = name != ids[s:e]
            out.append(pd.DataFrame({"u": ids[s:e][apart], "v": name[apart], "d": -1.0}))
            i, j, d = np.r_[i, j], np.r_[j, i], np.r_[d, d]
            first = _first(i, rank[j], d, k)
            out.append(pd.DataFrame({"u": ids[s + i[first]], "v": ids[s + j[first]], "d": d[first]}))
        return pd.concat(out, ignore_index=True)

    found = met_in_tables(cut(packed_rows(rows, shared, ["group"])), n, plan, 8192, work, f"u {kind}, v {kind}, d double")
    label = connected(found.filter("d < 0").select("u", "v"))
    named = cut(rows.select("id", "group").join(label.withColumnRenamed("u", "id"), "id", "left").select("id", "group", F.coalesce("label", "id").alias("cluster")))
    near = found.filter("d >= 0").withColumn("_r", F.row_number().over(W.partitionBy("u").orderBy("d", "v"))).filter(F.col("_r") <= k)
    edges = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.rint(F.lit(UNIT) / (F.lit(0.05 * reach) + F.col("d"))).cast("long").alias("w")).dropDuplicates(["a", "b"])
    edges = edges.join(named.withColumnRenamed("id", "a"), "a")
    edges = cut(edges.join(edges.groupBy("group").agg((2 * F.sum("w")).cast("double").alias("m")), "group").select("cluster", "a", "b", "w", "m"))
    community = cut(_divided(edges, kind, 4 * whole))
    of = lambda end: community.toDF(end, f"c{end}")
    inside = edges.join(of("a"), "a").join(of("b"), "b").filter("ca = cb")
    degree = inside.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg((F.sum("w") / F.lit(UNIT)).alias("degree"))
    piece = connected(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("id", "p")
    return named.join(community.toDF("id", "c"), "id", "left").join(degree, "id", "left").join(piece, "id", "left").select(
        "id", "group", "cluster", F.coalesce("p", "id").alias("piece"), F.concat(F.col("cluster").cast("string"), F.lit("/"), F.coalesce("c", "id").cast("string")).alias("community"), F.coalesce("degree", F.lit(0.0)).alias("degree"))


def _met_pairs(m: Met, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, distance) of what was met, each pair once. Of many copies only those with the first k + 1 of a class: the others are nobody's k nearest."""
    by_i, by_j = np.argsort(m.of_left, kind="stable"), np.argsort(m.of_right, kind="stable")
    n = max(m.of_left.max(initial=-1), m.of_right.max(initial=-1)) + 2
    start_i, start_j = (np.searchsorted(c[b], np.arange(n)) for c, b in ((m.of_left, by_i), (m.of_right, by_j)))
    same = np.intersect1d(m.of_left, m.of_right) if m.table == 0 else np.empty(0, int)
    i, j, d = np.r_[m.i, same], np.r_[m.j, same], np.r_[m.distance, np.zeros(len(same))]
    few_i, few_j = np.minimum(start_i[i] + k + 1, start_i[i + 1]), np.minimum(start_j[j] + k + 1, start_j[j + 1])
    out = []
    for lo, hi, first, last in ((start_i[i], start_i[i + 1], start_j[j], few_j), (start_i[i], few_i, few_j, start_j[j + 1])):
        pair, at = ranges(lo, hi)
        of, to = ranges(first[pair], last[pair])
        a, b, own = m.left[by_i[at]][of], m.right[by_j[to]], (i == j)[pair][of] & m.one
        ok = ~own | (b < a)
        out.append((a[ok], b[ok], d[pair][of][ok]))
    return tuple(np.concatenate([o[p] for o in out]) for p in range(3))


def _divided(edges: DataFrame, kind: str, most: int, passes: int = 10) -> DataFrame:
    """(u, label): the communities of ``edges`` (cluster, a, b, w, m), as ``modularity_communities`` has them; clusters of over ``most`` edges by joins."""
    parts, names = [], None

    def within(left: int):  # noqa: ANN202
        def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            name, at = np.unique(np.r_[batch.a.to_numpy(), batch.b.to_numpy()], return_inverse=True)
            a, b = at[: len(batch)], at[len(batch) :]
            m, hashes = np.ones(len(name)), np.zeros(len(name), np.int64)
            m[a] = m[b] = batch.m.to_numpy()
            hashes[a], hashes[b] = batch.ha.to_numpy(), batch.hb.to_numpy()
            return pd.DataFrame({"node": name, "label": name[modularity_communities(len(name), a, b, batch.w.to_numpy().astype(float), left, m, hashes)]})

        return work

    for left in range(passes, 0, -1):
        big = cut(edges.groupBy("cluster").count().filter(F.col("count") > most).select("cluster"))
        last = big.isEmpty()
        few = (edges if last else edges.join(big, "cluster", "left_anti")).withColumns({"ha": F.xxhash64("a"), "hb": F.xxhash64("b")})
        done = map_segments(few, ["cluster"], ["a", "b"], within(left), f"node {kind}, label {kind}")
        parts.append(done.toDF("u", "label") if names is None else names.join(done, "node").select("u", "label"))
        if last:
            break
        edges = edges.join(big, "cluster", "left_semi")
        moved = _moves_spread(edges)
        names = cut(moved.toDF("u", "node") if names is None else names.join(moved, "node").select("u", F.col("label").alias("node")))
        to = lambda end, moved=moved: moved.toDF(end, f"n{end}")
        edges = cut(edges.join(to("a"), "a").join(to("b"), "b").groupBy("cluster", "m", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.sum("w").alias("w")).select("cluster", "a", "b", "w", "m"))
    else:
        parts.append(names.select("u", F.col("node").alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _moves_spread(edges: DataFrame) -> DataFrame:
    """(node, label): ``_moves`` over the cluster."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"), "w", "m").select("e.u", "e.v", "w", "m")
    both = cut(ends.filter("u <> v").select("u", "v", "w"))
    own = cut(ends.groupBy("u").agg(F.sum("w").cast("double").alias("degree"), F.first("m").alias("m")).withColumn("c", F.col("u")))
    for r in range(ROUNDS):
        weight = own.groupBy("c").agg(F.sum("degree").alias("weight"))
        by = both.join(own.select(F.col("u").alias("v"), F.col("c").alias("to")), "v").groupBy("u", "to").agg(F.sum("w").cast("double").alias("by"))
        gain = F.col("by") - F.col("degree") * F.col("weight") / F.col("m")
        best = by.join(own, "u").join(weight.toDF("to", "weight"), "to").groupBy("u").agg(
            F.max(F.when(F.col("to") == F.col("c"), F.col("by"))).alias("here"),
            F.min(F.when(F.col("to") != F.col("c"), F.struct((-gain).alias("loss"), "to"))).alias("best"))
        stay = F.coalesce("here", F.lit(0.0)) - F.col("degree") * (F.col("weight") - F.col("degree")) / F.col("m")
        goes = F.coalesce(-F.col("best.loss") > stay + F.lit(LEAST_GAIN), F.lit(False))
        turn = F.shiftright(F.xxhash64("u"), r).bitwiseAND(F.lit(1)) == 0
        own = cut(own.join(weight, "c").join(best, "u", "left").select("u", "degree", "m", F.when(goes & turn, F.col("best.to")).otherwise(F.col("c")).alias("c"), goes.alias("goes")))
        settled = own.filter("goes").isEmpty()
        own = own.drop("goes")
        if settled:
            break
    low = own.groupBy("c").agg(F.min("u").alias("label"))
    return cut(own.join(low, "c").select(F.col("u").alias("node"), "label"))


def same_cluster_pairs(found: DataFrame, least: int = 5) -> DataFrame:
    """(a, b), a < b: pairs of members of one cluster of at least ``least`` members."""
    found = cut(found.select("cluster", "id"))  # used three times: two columns, instead of the work that made them
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("cluster")
    members = found.select("cluster", "id").join(sizes, "cluster")
    return members.withColumnRenamed("id", "a").join(members.withColumnRenamed("id", "b"), "cluster").filter("a < b").select("a", "b")


def describe(found: DataFrame, features: DataFrame, *, id: str, quality: str, depth: str, least: int = 5, top: int = 3) -> DataFrame:
    """One row for each cluster: size, communities, pieces before the exact check, typical members (highest weighted degree), best (highest quality) and depth.

    Ties are broken by the id; members without a row or with a null or NaN quality can't be best.
    """
    q = F.col(quality)
    f = features.select(F.col(id).alias("id"), F.when(~F.isnan(q), q).alias("quality"), F.when(~F.isnan(depth), F.col(depth)).alias("depth")).dropDuplicates(["id"])
    m = found.join(f, "id", "left")
    best = lambda order, ok: F.slice(F.array_sort(F.array_agg(F.when(ok, order))), 1, top)
    # two levels, so that no task sees a whole cluster: the first of every bucket of ids, then the first of those
    part = m.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).withColumn("_t", F.struct((-F.col("degree")).alias("by"), "id")).withColumn("_q", F.struct((-F.col("quality")).alias("by"), "id"))
    part = part.groupBy("group", "cluster", "_b").agg(
        F.count(F.lit(1)).alias("n"), best(F.col("_t"), F.lit(True)).alias("_t"), best(F.col("_q"), F.col("quality").isNotNull()).alias("_q"),
        F.sum("depth").alias("_s"), F.count("depth").alias("_n"), F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    first = lambda c: F.transform(F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, top), lambda x: x["id"])
    parts = lambda c, n: m.select("group", "cluster", c).distinct().groupBy("group", "cluster").agg(F.count(F.lit(1)).alias(n))
    whole = part.groupBy("group", "cluster").agg(
        F.sum("n").alias("size"), first("_t").alias("typical"), first("_q").alias("best"),
        (F.sum("_s") / F.sum("_n")).alias("depth_mean"), F.min("lo").alias("depth_min"), F.max("hi").alias("depth_max"),
    ).filter(F.col("size") >= least)
    return whole.join(parts("community", "communities"), ["group", "cluster"]).join(parts("piece", "pieces"), ["group", "cluster"])
