"""The most similar vectors of every vector: hashed to buckets, scanned by four-bit tables, reranked exactly.

Method. A bounded sample (``sample`` vectors) gives the mean and the codebooks of a product quantiser: 16 centres, so four
bits, for each ``sub`` dimensions. Codes are chosen score-aware: the error along the vector itself weighs ``eta`` times as much
as the error across it, because only that part changes the inner product with a query that lies near the vector. For a block of
queries the inner products with all centres are tabulated, the tables of two neighbouring codes are joined to
one of 256 entries, and a scan adds up table rows by the bytes of each vector (fewer than 256 vectors, for which the tables cost more than they
save, are multiplied as the centres of their codes). Small buckets are scanned together. What passes the scan is reranked
by its exact distance.

What is compared. Only vectors that share a bucket are scanned. A bucket is a side of each of ``bits`` random planes, and there are
several tables of such buckets. A random direction turns a difference of length r, in d dimensions, into one of about r / sqrt(d), and a plane's
place is drawn evenly from two deviations of the data along it; so it parts two vectors at most ``reach`` apart with a probability
of at most reach * sqrt(2 / (pi d)) / (2 deviations), wherever they lie and whatever the data. The number of tables is chosen so
that the probability of sharing no bucket is at most ``loss``; for vectors nearer than ``reach`` it is far less. It rises with
the logarithm of the number of vectors, and is known before anything is compared.

In a bucket nothing is lost. In the scan |x-y|^2 is estimated as |x|^2 + |y|^2 - 2<x, code of y>; with e = y - code of y the estimate is at most
reach^2 + 2 reach |e| + 2 |<y, e>| for any y within reach. That bound, kept with each vector, is the scan's cut-off.

Vectors with fewer than k others within reach are looked for again where all k are asked for (``everyone``): in blocks against blocks of
all vectors, by their inner products, with a cut-off that allows for rounding, and reranked exactly. So these k are exact too, at any
distance. No plane or code helps so far out: this part takes time with the number of such vectors times that of all.

Scale. The number of planes is chosen so that a bucket holds about ``leaf`` vectors however many there are. Each vector is packed once,
without loss, with its sides, code and bounds, and held in a checkpoint. Tables are worked through in rounds of about ``ROUND`` vectors, at least a table each,
and a round's shuffle files are freed at its end; so disk holds the vectors twice at most, however many tables there are. A bucket that holds more than
``block``, as counted, is split into blocks by hash, and tasks are pairs of blocks, so that no task grows with the data and a bucket that
holds a third of all vectors becomes many tasks. Copies of one vector are scanned as one. A pair is reported by the first table that brings it together.
Each task already cuts its rows to the ``k`` nearest of each vector, ties kept, before the final rank.

Defined results. Vectors of another length, null, or with an element that is null, NaN or infinite take no part; nor do null
ids. A repeated id counts once, with the vector of the least hash. Ties count as defined: y is among the k nearest of x if fewer than k others are
strictly nearer. Fewer than two vectors give no pair. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import cut, map_segments, shuffles_freed

DIMENSIONS = 512


def usable(df: DataFrame, id: str, vector: str, dimensions: int, *more: str) -> DataFrame:
    """(id, v ARRAY<FLOAT>, more): the rows with a whole, finite vector."""
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<float>").alias("v"), *more).filter(F.col("id").isNotNull() & (F.size("v") == dimensions))
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def one_of_each(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows of which those of one id are alike (of differing vectors the one of the least hash stays), and how many ids there are."""
    seen = rows.select("id", F.xxhash64("v").alias("h")).groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    n, clashes = seen.agg(F.count(F.lit(1)), F.count_if(F.col("lo") != F.col("hi"))).first()
    if clashes:
        rows = rows.join(seen.filter("lo <> hi").select("id", "lo"), "id", "left").filter(F.col("lo").isNull() | (F.xxhash64("v") == F.col("lo"))).drop("lo")
    return rows, n


@dataclass
class Plan:
    """What the sample teaches, and the random planes."""

    mean: np.ndarray
    planes: np.ndarray  # (tables, bits, dimensions)
    places: np.ndarray  # (tables, bits)
    books: np.ndarray  # (subspaces, 16, sub)
    eta: float
    values: np.ndarray  # what the elements of the sample are, as their bits; empty if that is over 256 values

    def buckets(self, c: np.ndarray) -> np.ndarray:
        """(n, tables): the bucket of each centred vector in each table."""
        t, k, d = self.planes.shape
        side = (c @ self.planes.reshape(t * k, d).T > self.places.ravel()).reshape(len(c), t, k)
        return side @ (np.int64(1) << np.arange(k, dtype=np.int64)) + (np.arange(t, dtype=np.int64) << TABLE_BIT)

    @property
    def wide(self) -> int:
        """Bytes of a bucket's number within its table."""
        return max(1, -(-self.planes.shape[1] // 8))

    @property
    def head(self) -> int:
        """Bytes of a packed vector before the vector itself."""
        return self.planes.shape[0] * self.wide + 8 + -(-len(self.books) // 2)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """(n) bytes: of each vector the bucket in each table, error, error along it, code, and the vector itself."""
        c = x - self.mean
        code, error, along = codes_of(c, self.books, self.eta)
        buckets = self.buckets(c).astype(">u8").view(np.uint8).reshape(len(x), -1, 8)[:, :, 8 - self.wide :].reshape(len(x), -1)
        code = np.c_[code, np.zeros((len(x), len(self.books) % 2), np.uint8)]
        head = np.c_[buckets, np.stack([error, along], 1).astype("<f4").view(np.uint8), code[:, 0::2] * 16 + code[:, 1::2]]
        out = np.empty(len(x), object)
        known, body = squeezed(x, self.values)
        for at, b in ((np.flatnonzero(known), body), (np.flatnonzero(~known), x[~known].view(np.uint8))):
            out[at] = [r.tobytes() for r in np.concatenate([head[at], b], axis=1)]
        return out

    def heads(self, packed: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets (n, tables, bytes), error, error along the vector, and codes of packed vectors."""
        head, t, wide = self.head, self.planes.shape[0], self.wide
        h = np.frombuffer(b"".join([r[:head] for r in packed]), np.uint8).reshape(len(packed), head)
        bounds = np.ascontiguousarray(h[:, t * wide : t * wide + 8]).view("<f4")
        byte = h[:, t * wide + 8 :]
        code = np.stack([byte >> 4, byte & 15], axis=2).reshape(len(h), -1)[:, : len(self.books)]
        return h[:, : t * wide].reshape(len(h), t, wide), bounds[:, 0], bounds[:, 1], code

    def vectors(self, packed: pd.Series) -> np.ndarray:
        """The vectors themselves, of packed ones, bit by bit."""
        head = self.head
        body = [r[head:] for r in packed]
        d = self.planes.shape[2]
        whole = np.array([len(b) == 4 * d for b in body], bool)
        out = np.empty((len(body), d), np.float32)
        if whole.any():
            out[whole] = np.frombuffer(b"".join([b for b, w in zip(body, whole, strict=True) if w]), np.float32).reshape(-1, d)
        if not whole.all():
            out[~whole] = unsqueezed(b"".join([b for b, w in zip(body, whole, strict=True) if not w]), self.values, d)
        return out


def squeezed(x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors hold nothing but ``values``, and these as numbers of the values, of as many bits as these numbers need."""
    if not len(values):
        return np.zeros(len(x), bool), np.empty((0, 0), np.uint8)
    bits = np.ascontiguousarray(x).view(np.uint32)
    place = np.minimum(np.searchsorted(values, bits), len(values) - 1)
    known = (values[place] == bits).all(1)
    n, d = int(known.sum()), x.shape[1]
    number = np.zeros((n, -(-d // 8), 8), np.uint64)
    number.reshape(n, -1)[:, :d] = place[known]
    wide = bits_of(values)
    word = np.bitwise_or.reduce(number << (np.arange(8, dtype=np.uint64) * np.uint64(wide)), axis=2)  # eight numbers in so many bytes
    return known, word.astype("<u8").view(np.uint8).reshape(n, -1, 8)[:, :, :wide].reshape(n, -1)


def unsqueezed(b: bytes, values: np.ndarray, d: int) -> np.ndarray:
    wide = bits_of(values)
    part = np.frombuffer(b, np.uint8).reshape(-1, -(-d // 8), wide)
    word = np.zeros((*part.shape[:2], 8), np.uint8)
    word[:, :, :wide] = part
    word = word.view("<u8")  # (n, words, 1)
    number = (word >> (np.arange(8, dtype=np.uint64) * np.uint64(wide))).astype(np.uint8) & np.uint8((1 << wide) - 1)
    return values.view(np.float32)[number.reshape(len(part), -1)[:, :d]]


def bits_of(values: np.ndarray) -> int:
    return max(1, (len(values) - 1).bit_length())


#: The number of the table lies above so many bits of the bucket.
TABLE_BIT = 56
#: About so many vectors are shuffled at a time; a vector counts in each table.
ROUND = 500_000


def fit(sample: np.ndarray, n: int, *, reach: float, leaf: int, sub: int, eta: float, loss: float, seed: int = 7) -> Plan:
    """n: how many vectors there are in all; leaf: how many of them a bucket should hold."""
    mean = sample.mean(0, dtype=np.float64).astype(np.float32)
    c = sample - mean
    d = c.shape[1]
    rng = np.random.default_rng(seed)
    deviation = float(np.sqrt((c.astype(np.float64) ** 2).mean())) or 1.0  # along a random direction
    parts = min(reach * math.sqrt(2 / (math.pi * d)) / (2 * deviation), 1.0)
    alike = 0.6  # about the share of pairs that such a plane leaves together
    bits = min(max(0, math.ceil(math.log(leaf / max(n, 1)) / math.log(alike))), TABLE_BIT - 1)
    while bits and (met := (1 - parts) ** bits) < 0.3:  # the data is too dense for the reach: fewer planes, larger buckets
        bits -= 1
    met = (1 - parts) ** bits
    tables = 1 if met >= 1 - loss else math.ceil(math.log(loss) / math.log(1 - met))
    planes = rng.normal(size=(tables, bits, d))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True) if bits else 1
    places = rng.uniform(-deviation, deviation, (tables, bits))
    values = np.unique(np.ascontiguousarray(sample, np.float32).view(np.uint32))
    return Plan(mean, planes.astype(np.float32), places.astype(np.float32), _books(c, sub, seed), eta, values if len(values) <= 256 else values[:0])


def _books(c: np.ndarray, sub: int, seed: int, rounds: int = 8) -> np.ndarray:
    """16 centres for each subspace, by k-means of the sample."""
    rng = np.random.default_rng(seed)
    books = []
    for s in range(0, c.shape[1], sub):
        x = c[:, s : s + sub]
        centre = x[rng.choice(len(x), 16, replace=len(x) < 16)].copy()
        for _ in range(rounds):
            a = ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)
            n = np.bincount(a, minlength=16)
            for d in range(x.shape[1]):
                centre[:, d] = np.where(n > 0, np.bincount(a, x[:, d], 16) / np.maximum(n, 1), centre[:, d])
        books.append(centre)
    return np.stack(books).astype(np.float32)


def codes_of(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score-aware codes (n, subspaces), the error's length and its part along x (times |x|) for centred vectors."""
    n, m, sub = len(x), len(books), books.shape[2]
    norm = np.linalg.norm(x, axis=1) + 1e-12
    unit = x / norm[:, None]
    dots = np.empty((m, n, 16), np.float32)  # error along x of each choice
    size = np.empty((m, n, 16), np.float32)  # squared error of each choice
    for s in range(m):
        xs, us, b = x[:, s * sub : (s + 1) * sub], unit[:, s * sub : (s + 1) * sub], books[s]
        dots[s] = (xs * us).sum(1)[:, None] - us @ b.T
        size[s] = (xs * xs).sum(1)[:, None] - 2 * xs @ b.T + (b * b).sum(1)[None]
    code = size.argmin(2)
    rows = np.arange(n)
    along = np.take_along_axis(dots, code[:, :, None], 2)[:, :, 0]  # (m, n)
    total = along.sum(0)
    for _ in range(rounds):
        for s in range(m):
            rest = total - along[s]
            pick = (size[s] + (eta * m - 1) * (rest[:, None] + dots[s]) ** 2).argmin(1)
            code[s], along[s] = pick, dots[s][rows, pick]
            total = rest + along[s]
    error = np.sqrt(np.maximum(np.take_along_axis(size, code[:, :, None], 2)[:, :, 0].sum(0), 0))
    return code.T.astype(np.uint8), error, np.abs(total) * norm


def scan(q: np.ndarray, code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Estimated inner products (vectors, queries), by table rows; of fewer vectors than a table has rows, by their codes' centres themselves."""
    m, _, sub = books.shape
    if len(code) < 256:
        return books[np.arange(m), code].reshape(len(code), -1) @ q.T
    if m % 2:
        code, books, m = np.c_[code, np.zeros(len(code), np.uint8)], np.concatenate([books, np.zeros_like(books[:1])]), m + 1
        q = np.c_[q, np.zeros((len(q), sub), q.dtype)]
    byte = code[:, 0::2] * 16 + code[:, 1::2]
    out = np.zeros((len(code), len(q)), np.float32)
    row = np.empty_like(out)
    for s in range(m // 2):
        a, b = (books[2 * s + k] @ q[:, (2 * s + k) * sub : (2 * s + k + 1) * sub].T for k in (0, 1))
        np.take((a[:, None, :] + b[None, :, :]).reshape(256, -1), byte[:, s], axis=0, out=row)
        out += row
    return out


def near_pairs(x: np.ndarray, y: np.ndarray | None, plan: Plan, reach: float, coded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, queries: int = 512, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i in x, j in y, distance) of all pairs within reach; with y None, pairs i < j within x. coded: what ``codes_of`` gives for x. part: rises with i;
    with y None, only pairs within the same part."""
    base = x
    c = base - plan.mean
    code, error, along = codes_of(c, plan.books, plan.eta) if coded is None else coded
    own = (c * c).sum(1)
    bound = reach * reach + 2 * reach * error + 2 * along + 1e-3 * (1 + own)
    others = base if y is None else y
    out = []
    for lo in range(0, len(others), queries):
        o = others[lo : lo + queries]
        rows = slice(0 if part is None else np.searchsorted(part, part[lo]), len(base) if y is not None else lo + len(o))  # of pairs within x only i < j are wanted
        q = o - plan.mean
        est = own[rows, None] + (q * q).sum(1)[None, :] - 2 * scan(q, code[rows], plan.books)
        i, j = np.nonzero(est <= bound[rows, None])
        i += rows.start
        if y is None:
            keep = i < j + lo if part is None else (i < j + lo) & (part[i] == part[j + lo])
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 20_000):
            d = base[i[s : s + 20_000]].astype(np.float64) - o[j[s : s + 20_000]]
            dist = np.sqrt((d * d).sum(1))
            ok = dist <= reach
            out.append((i[s : s + 20_000][ok], j[s : s + 20_000][ok] + lo, dist[ok]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def vectors_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def planned(rows: DataFrame, n: int, *, reach: float, sample: int, leaf: int, sub: int = 8, eta: float = 4.0, loss: float = 1e-3) -> Plan | None:
    """The plan for ``n`` vectors in ``rows`` (id, v ARRAY<FLOAT>), from a sample chosen by a hash of the id."""
    if n < 2:
        return None
    share = min(1_000_000, math.ceil(1_000_000 * sample / n))
    packed = lambda d: d.select("v").mapInPandas(_pack, "vec binary").limit(2 * sample).toPandas().vec
    got = packed(rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share))
    if not len(got):
        got = packed(rows)
    return fit(vectors_of(got), n, reach=reach, leaf=leaf, sub=sub, eta=eta, loss=loss)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"vec": [np.asarray(v, np.float32).tobytes() for v in b.v]})


def packed_rows(rows: DataFrame, shared, more: list[str]) -> DataFrame:  # noqa: ANN001
    """(id, vec, more): each vector as ``Plan.packed`` has it."""
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                b = whole.iloc[lo : lo + 2000]
                if len(b):
                    yield pd.DataFrame({"id": b.id, "vec": shared.value.packed(np.stack(b.v.to_numpy()).astype(np.float32))} | {c: b[c] for c in more})

    return rows.select("id", "v", *more).mapInPandas(work, f"id {kinds['id']}, vec binary" + "".join(f", `{c}` {kinds[c]}" for c in more))


def leaves(plan: Plan, tables: range) -> Column:
    """The bucket of a packed vector in each of the tables, with the table's number, as ``Plan.buckets`` has them."""
    one = lambda t: F.conv(F.hex(F.substring("vec", 1 + t * plan.wide, plan.wide)), 16, 10).cast("long") + F.lit(t << TABLE_BIT)
    return F.explode(F.array(*[one(t) for t in tables]))


def hot_buckets(packed: DataFrame, n: int, plan: Plan, block: int) -> pd.DataFrame:
    """(leaf, blocks): the buckets of more than ``block`` rows and the number of blocks of each; at most n / block of them in a table."""
    if n <= block:
        return pd.DataFrame({"leaf": np.empty(0, np.int64), "blocks": np.empty(0, np.int64)})
    count = packed.select(leaves(plan, range(len(plan.planes))).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    return count.select("leaf", F.ceil(F.col("n") / block).cast("long").alias("blocks")).toPandas()


def spread(packed: DataFrame, plan: Plan, tables: range, hot: pd.DataFrame) -> DataFrame:
    """(leaf, a, b, side, id, vec, more): each packed vector in all the tasks (bucket, block a, block b) of these tables that need it."""
    rows = packed.select(leaves(plan, tables).alias("leaf"), "*")
    hot = hot[(hot.leaf.to_numpy(np.int64) >> TABLE_BIT >= tables.start) & (hot.leaf.to_numpy(np.int64) >> TABLE_BIT < tables.stop)]
    if not len(hot):
        return rows.select("leaf", *[F.lit(0).alias(c) for c in ("a", "b", "side")], *packed.columns)
    many = packed.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(hot.leaf, hot.blocks, strict=True)], "leaf long, blocks long")
    rows = rows.join(F.broadcast(many), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))  # tasks of the pairs of blocks
    return rows.select("leaf", F.least("own", "k").alias("a"), F.greatest("own", "k").alias("b"), (F.col("own") > F.col("k")).cast("int").alias("side"), *packed.columns)


def met_in_tables(packed: DataFrame, n: int, plan: Plan, block: int, work, schema: str) -> DataFrame:  # noqa: ANN001
    """What ``work`` (see ``map_segments``) makes of the tasks of all tables; ``packed`` must be a checkpoint, as each round reads it."""
    hot = hot_buckets(packed, n, plan, block)
    tables, some = len(plan.planes), max(1, ROUND // max(n, 1))
    out = []
    for lo in range(0, tables, some):
        with shuffles_freed(packed.sparkSession):
            out.append(cut(map_segments(spread(packed, plan, range(lo, min(lo + some, tables)), hot), ["leaf", "a", "b"], ["side", "id"], work, schema)))
    return reduce(DataFrame.unionByName, out)


@dataclass
class Met:
    """What a task brings together: near pairs (i, j) of different vectors, as classes of equal ones, and the rows of both sides with their classes."""

    i: np.ndarray
    j: np.ndarray
    distance: np.ndarray
    left: np.ndarray
    right: np.ndarray
    of_left: np.ndarray
    of_right: np.ndarray
    one: bool  # both sides are the same rows
    table: int


def met_in(batch: pd.DataFrame, s: int, e: int, plan: Plan, reach: float, by: str | None = None, joined: bool = False) -> Met:
    """The pairs of the task in rows s to e that no earlier table brings together; rows of a repeated id are left out. by: classes are apart where this differs. joined: rows s to e are several
    unsplit buckets, which ``by`` numbers in order."""
    at, ids, vec, side, leaf, key = (np.arange(s, e), *(batch[c].to_numpy()[s:e] if c else None for c in ("id", "vec", "side", "leaf", by)))
    if not pd.Index(ids).is_unique:
        once = np.flatnonzero(~(pd.DataFrame({"id": ids}) if by is None else pd.DataFrame({"id": ids, by: key})).duplicated().to_numpy())
        at, ids, vec, side, key = (None if c is None else c[once] for c in (at, ids, vec, side, key))
    one = bool(batch.a.iloc[s] == batch.b.iloc[s])
    table = int(leaf[0]) >> TABLE_BIT
    head, wide = plan.head, plan.wide
    alike = [v[head:] for v in vec] if by is None else [(v[head:], b) for v, b in zip(vec, key.tolist(), strict=True)]
    if len(set(alike)) == len(alike):
        cls = first = np.arange(len(alike))
    else:
        names: dict = {}
        cls = np.array([names.setdefault(v, len(names)) for v in alike])
        first = np.full(len(names), len(alike))
        np.minimum.at(first, cls, np.arange(len(alike)))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if one else 1))
    lc, rc = np.unique(cls[left]), np.unique(cls[right])
    i, j, d = np.empty(0, int), np.empty(0, int), np.empty(0)
    if len(lc) and len(rc) and (not one or len(lc) > 1):
        _, error, along, code = plan.heads(vec[first[lc]])
        part = key[first[lc]] if joined else None
        i, j, d = near_pairs(plan.vectors(vec[first[lc]]), None if one else plan.vectors(vec[first[rc]]), plan, reach, (code, error, along), *((128, part) if joined else ()))
        i, j = lc[i], rc[j]
        ok = i != j
        if table and ok.any():
            b = np.frombuffer(b"".join([v[: table * wide] for v in vec[first]]), np.uint8).reshape(len(first), table, wide)
            ok &= ~(b[i] == b[j]).all(2).any(1)
        i, j, d = i[ok], j[ok], d[ok]
    return Met(i, j, d, at[left], at[right], cls[left], cls[right], one, table)


def together(batch: pd.DataFrame, starts: np.ndarray, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Segments in runs of at most ``most`` rows that ``met_in`` can take at once, as the first rows of the runs; and the segment of each row. Only unsplit buckets of one table go together."""
    ends = np.r_[starts[1:], len(batch)]
    a, b, table = (batch[c].to_numpy()[starts] for c in ("a", "b", "leaf"))
    table, one = table >> TABLE_BIT, a == b
    runs = [0]
    for k in range(1, len(starts)):
        f = runs[-1]
        if not (one[f] and one[k] and table[f] == table[k] and ends[k] - starts[f] <= most):
            runs.append(k)
    return starts[runs], np.repeat(np.arange(len(starts)), ends - starts)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the place, for every place from each lo to its hi."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]


def nearest_of(m: Met, k: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other, distance): of the rows met, the k nearest of each row, ties kept, in parts of some ``most`` rows."""
    same = np.empty(0, int)  # copies meet in every table; the first reports them
    if m.table == 0:
        same = np.flatnonzero(np.bincount(m.of_left) > 1) if m.one else np.intersect1d(m.of_left, m.of_right)
    zero = np.zeros(len(same))
    if m.one:
        yield from _directed(np.r_[m.i, m.j, same], np.r_[m.j, m.i, same], np.r_[m.distance, m.distance, zero], m.left, m.right, m.of_left, m.of_right, True, k, most)
    else:
        yield from _directed(np.r_[m.i, same], np.r_[m.j, same], np.r_[m.distance, zero], m.left, m.right, m.of_left, m.of_right, False, k, most)
        yield from _directed(np.r_[m.j, same], np.r_[m.i, same], np.r_[m.distance, zero], m.right, m.left, m.of_right, m.of_left, False, k, most)


def _directed(i, j, d, rows_i, rows_j, cls_i, cls_j, one, k, most):  # noqa: ANN001, ANN202
    """From each row of the classes i to the rows of its k nearest classes j, ties kept; ``one``: a class may be its own neighbour, a row not."""
    if not len(i):
        return
    classes = max(i.max(), j.max(), cls_i.max(), cls_j.max()) + 1
    size = np.bincount(cls_j, minlength=classes)
    o = np.lexsort((d, i))
    i, j, d = i[o], j[o], d[o]
    new = np.r_[True, i[1:] != i[:-1]]
    tie = new | np.r_[True, d[1:] != d[:-1]]
    n = size[j] - (one & (i == j))
    before = np.cumsum(n) - n
    nearer = before[np.flatnonzero(tie)[np.cumsum(tie) - 1]] - before[np.flatnonzero(new)[np.cumsum(new) - 1]]
    i, j, d = (v[nearer < k] for v in (i, j, d))
    by_i, by_j = np.argsort(cls_i, kind="stable"), np.argsort(cls_j, kind="stable")
    start_i, start_j = (np.searchsorted(c[b], np.arange(classes + 1)) for c, b in ((cls_i, by_i), (cls_j, by_j)))
    pair, at = ranges(start_i[i], start_i[i + 1])
    row, j, d = rows_i[by_i[at]], j[pair], d[pair]
    part = np.cumsum(size[j]) // most
    for lo, hi in zip(at_ := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), np.r_[at_[1:], len(part)], strict=True):
        of, at = ranges(start_j[j[lo:hi]], start_j[j[lo:hi] + 1])
        a, b, dist = row[lo:hi][of], rows_j[by_j[at]], d[lo:hi][of]
        ok = a != b
        yield a[ok], b[ok], dist[ok]


def similar(df: DataFrame, *, id: str, vector: str, k: int = 4, reach: float = 1.5, dimensions: int = DIMENSIONS, sample: int = 8_192, leaf: int = 512, block: int = 8192, loss: float = 1e-3, everyone: bool = False) -> DataFrame:
    """(id, other, distance): the k nearest others of each vector that are at most ``reach`` away, ties included.

    loss: the most probable share of pairs exactly ``reach`` apart that are missed. everyone: also those farther away than
    ``reach``, for the vectors that have fewer than k within it.
    """
    rows, n = one_of_each(usable(df, id, vector, dimensions))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, other {kind}, distance double"
    plan = planned(rows, n, reach=reach, sample=sample, leaf=leaf, loss=loss)
    if plan is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(plan)

    def work(batch: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ids = batch.id.to_numpy()
        held: list[tuple] = []
        starts, segment = together(batch, starts)
        batch = batch.assign(segment=segment)
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            for part in nearest_of(met_in(batch, s, e, shared.value, reach, "segment", segment[s] != segment[e - 1]), k):
                held.append(part)
                if sum(len(h[0]) for h in held) > 500_000:
                    yield _pairs(held, ids)
                    held = []
        yield _pairs(held, ids)

    packed = cut(packed_rows(rows, shared, []))
    near = met_in_tables(packed, n, plan, block, work, schema)
    ranked = lambda d: d.withColumn("_r", F.rank().over(W.partitionBy("id").orderBy("distance"))).filter(F.col("_r") <= k).drop("_r")
    if not everyone:
        return ranked(near)
    near = cut(ranked(near))
    full = cut(near.groupBy("id").count().filter(F.col("count") >= k).select("id"))
    packed = packed.dropDuplicates(["id"])
    few = packed.join(full, "id", "left_anti")
    return near.join(full, "id", "left_semi").unionByName(ranked(_nearest_of(few, packed, shared, k, block, schema)))


def _pairs(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray) -> pd.DataFrame:
    a, b, d = (np.concatenate([h[p] for h in held]) if held else np.empty(0, int) for p in range(3))
    return pd.DataFrame({"id": ids[a], "other": ids[b], "distance": d.astype(float)})


def _top(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which of the directed rows i -> j are among the k nearest of i, ties kept."""
    o = np.lexsort((d, i))
    first = np.r_[True, i[o][1:] != i[o][:-1]]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    kth = np.minimum(start + k - 1, np.r_[np.flatnonzero(first)[1:], len(o)][np.cumsum(first) - 1] - 1)
    keep = np.zeros(len(i), bool)
    keep[o] = d[o] <= d[o][kth]
    return keep


def _nearest_of(few: DataFrame, rows: DataFrame, shared, k: int, block: int, schema: str) -> DataFrame:  # noqa: ANN001
    """(id, other, distance): for each of ``few`` its k nearest others in each block of ``rows``, ties kept."""
    few = cut(few.select("id", "vec"))
    a, b = (max(1, math.ceil(d.count() / block)) for d in (rows, few))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.select(of(a).alias("a"), every(b).alias("b"), F.lit(0).alias("side"), "id", "vec")
    asked = few.select(every(a).alias("a"), of(b).alias("b"), F.lit(1).alias("side"), "id", "vec")

    def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = [pd.DataFrame({"id": pd.Series([], dtype=object), "other": pd.Series([], dtype=object), "distance": pd.Series([], dtype=float)})]
        side, ids = batch.side.to_numpy(), batch.id.to_numpy()
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            at = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
            if not len(at[0]) or not len(at[1]):
                continue
            x, q = (shared.value.vectors(batch.vec.iloc[p]) for p in at)
            i, j, d = nearest_in(q, x, pd.Index(ids[at[0]]).get_indexer(ids[at[1]]), k, shared.value.mean)
            out.append(pd.DataFrame({"id": ids[at[1][i]], "other": ids[at[0][j]], "distance": d}))
        return pd.concat(out, ignore_index=True)

    return map_segments(base.unionByName(asked), ["a", "b"], ["side"], work, schema)


def nearest_in(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, mean: np.ndarray, queries: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i in q, j in x, distance): the k nearest in x of each of q, ties kept. own: the place in x of each of q itself, or -1."""
    c = x - mean
    sq = (c * c).sum(1)
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for lo in range(0, len(q), queries):
        o = q[lo : lo + queries] - mean
        oq = (o * o).sum(1)
        est = oq[:, None] + sq[None] - 2 * o @ c.T
        self_ = np.flatnonzero(own[lo : lo + queries] >= 0)
        est[self_, own[lo : lo + queries][self_]] = np.inf
        slip = 2e-4 * (oq[:, None] + sq[None] + 1)  # more than single precision can be off, twice
        kth = np.partition(est + slip / 2, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        i, j = np.nonzero((est - slip / 2 <= kth[:, None]) & np.isfinite(est))
        d = np.concatenate([np.sqrt(((q[lo + i[p : p + 20_000]].astype(np.float64) - x[j[p : p + 20_000]]) ** 2).sum(1)) for p in range(0, len(i), 20_000)] or [np.empty(0)])
        if len(i):
            keep = _top(i, j, d, k)
            out.append((lo + i[keep], j[keep], d[keep]))
    return tuple(np.concatenate([o[p] for o in out]) for p in range(3))
