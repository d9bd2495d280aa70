import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from tidemark.llm import vectors
from tidemark.llm.vectors import TABLE_BIT, codes_of, fit, near_pairs, scan, similar
from tidemark.runtime import segment_starts


def made(n=600, d=32, seed=0):
    r = np.random.default_rng(seed)
    places = r.normal(0, 3, (n // 12, d))
    x = (places[r.integers(0, len(places), n)] + r.normal(0, 0.12, (n, d))).astype(np.float32)
    x[:40] = x[0]  # copies
    return np.round(x * 16) / 16


def brute(x, k, reach):
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {(i, j) for i in range(len(x)) for j in np.flatnonzero(d[i] <= reach) if (d[i] < d[i, j]).sum() < k}


@pytest.mark.parametrize("block", [4096, 60])
def test_all_neighbours_are_found(spark, block):
    x = made()
    rows = [(f"f{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("f0003", x[3].tolist()), ("bad1", None), ("bad2", x[0, :5].tolist()), ("bad3", [float("nan"), *x[0, 1:].tolist()]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "frame_id string, img array<float>")
    got = {(int(r.id[1:]), int(r.other[1:])) for r in similar(df, id="frame_id", vector="img", dimensions=32, reach=1.5, sample=200, leaf=80, block=block).collect()}
    want = brute(x, 4, 1.5)
    assert got == want and len(want) > 1000


def test_scan_and_bound():
    x = made(400)
    plan = fit(x, len(x), reach=1.5, leaf=50, sub=8, eta=4.0, loss=1e-4)
    c = x - plan.mean
    code, error, along = codes_of(c, plan.books, plan.eta)
    at = np.concatenate([plan.books[s][code[:, s]] for s in range(len(plan.books))], axis=1)
    assert np.allclose(scan(c[:30], code, plan.books), at @ c[:30].T, atol=1e-2)
    assert np.allclose(np.linalg.norm(c - at, axis=1), error, atol=1e-2)
    assert np.allclose(np.abs(((c - at) * c).sum(1)), along, atol=0.05)
    plain = ((c - np.concatenate([plan.books[s][((c[:, s * 8 : s * 8 + 8, None] - plan.books[s].T[None]) ** 2).sum(1).argmin(1)] for s in range(4)], axis=1)) * c).sum(1)
    assert np.abs(along).mean() < np.abs(plain).mean()  # the parallel error is the smaller for being weighed
    i, j, d = near_pairs(x, None, plan, 1.5)
    assert {(a, b) for a, b in zip(i, j)} == {(a, b) for a, b in brute(x, 10**9, 1.5) if a < b}


def test_empty_and_single(spark):
    schema = "frame_id string, img array<float>, id int, other int"
    assert similar(spark.createDataFrame([], schema), id="frame_id", vector="img", dimensions=4).count() == 0
    assert similar(spark.createDataFrame([("a", [1.0] * 4, 1, 1)], schema), id="frame_id", vector="img", dimensions=4).count() == 0
    two = similar(spark.createDataFrame([("a", [1.0] * 4, 1, 1), ("b", [1.0] * 4, 1, 1)], schema), id="frame_id", vector="img", dimensions=4, reach=0.5).collect()
    assert {(r.id, r.other, r.distance) for r in two} == {("a", "b", 0.0), ("b", "a", 0.0)}


@pytest.mark.parametrize("block", [4096, 60])
def test_everyone_has_k(spark, block):
    x = np.concatenate([made(300), np.random.default_rng(3).normal(0, 8, (60, 32)).astype(np.float32)])  # the last have none within reach
    df = spark.createDataFrame([(f"f{i:04d}", v.tolist()) for i, v in enumerate(x)], "frame_id string, img array<float>")
    got = {(int(r.id[1:]), int(r.other[1:])) for r in similar(df, id="frame_id", vector="img", dimensions=32, reach=1.5, sample=200, leaf=80, block=block, everyone=True).collect()}
    assert got == brute(x, 4, np.inf)
    assert min(np.bincount([i for i, _ in got], minlength=len(x))) >= 4


@pytest.mark.parametrize("where", [0.0, 0.3, 3.0])
def test_pairs_at_the_reach_meet(where):
    """At any place, and whatever the sample holds: of pairs exactly ``reach`` apart hardly any shares no bucket."""
    r = np.random.default_rng(5)
    sample = np.concatenate([np.repeat(r.normal(0, 1, (1, 256)), 500, 0), r.normal(0, 1, (1500, 256))]).astype(np.float32)
    missed = []
    for seed in range(4):
        plan = fit(sample, 5_000_000, reach=1.5, leaf=512, sub=8, eta=4.0, loss=1e-3, seed=seed)
        x = (r.normal(0, 1, (4000, 256)) * where).astype(np.float32)
        step = r.normal(size=x.shape)
        y = x + (1.5 * step / np.linalg.norm(step, axis=1, keepdims=True)).astype(np.float32)
        missed.append((plan.buckets(x) != plan.buckets(y)).all(1).mean())
    assert np.mean(missed) < 2e-3, missed
    far = plan.buckets(sample[500:])
    assert 3 < plan.planes.shape[0] < 40 and all(np.unique(far[:, t]).size > 500 for t in range(far.shape[1]))
    assert (far >> TABLE_BIT == np.arange(far.shape[1])).all()


def test_differing_vectors_of_one_id(spark):
    rows = [("a", [0.0] * 8), ("a", [9.0] * 8), ("b", [0.1] * 8), ("c", [9.1] * 8)]
    got = {frozenset((r.id, r.other)) for r in similar(spark.createDataFrame(rows, "frame_id string, img array<float>"), id="frame_id", vector="img", dimensions=8).collect()}
    assert len(got) == 1 and "a" in next(iter(got))
    again = {frozenset((r.id, r.other)) for r in similar(spark.createDataFrame(rows[::-1], "frame_id string, img array<float>"), id="frame_id", vector="img", dimensions=8).collect()}
    assert got == again


@pytest.mark.parametrize("few", [True, False])
def test_disk_does_not_grow_with_the_tables(spark, few, monkeypatch):
    """Each table's shuffle files are gone when the next begins: what is left is less than the vectors take once."""
    monkeypatch.setattr(vectors, "ROUND", 1, raising=False)
    r = np.random.default_rng(1)
    x = r.normal(0, 0.7, (1000, 512)).astype(np.float32)
    x[500:] = x[:500] + r.normal(0, 0.06, (500, 512)).astype(np.float32)
    x = np.round(x * 16) / 16 if few else x
    df = spark.createDataFrame([(f"f{i:04d}", v.tolist()) for i, v in enumerate(x)], "frame_id string, img array<float>")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f: f.stat().st_size for d in disk.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    before = held()
    got = {(int(q.id[1:]), int(q.other[1:])) for q in similar(df, id="frame_id", vector="img", leaf=16).collect()}
    assert got == brute(x, 4, 1.5) and len(got) > 500
    for _ in range(100):  # files are removed in the background
        left = sum(n for f, n in held().items() if f not in before)
        if left < x.nbytes:
            break
        time.sleep(0.1)
    assert left < x.nbytes, (left, x.nbytes)


@pytest.mark.parametrize("d", [32, 21])
def test_packed_without_loss(d):
    r = np.random.default_rng(2)
    x = (r.integers(-20, 20, (300, d)) / 16).astype(np.float32)
    plan = fit(x, 10**6, reach=1.5, leaf=50, sub=8 if d == 32 else 7, eta=4.0, loss=1e-3)
    x[5, 3], x[6, 0] = 0.123, -0.0  # not in the sample
    packed = plan.packed(x)
    assert (plan.vectors(packed).view(np.uint32) == x.view(np.uint32)).all()
    assert len(packed[0]) - plan.head < 4 * d == len(packed[5]) - plan.head == len(packed[6]) - plan.head
    side, error, along, code = plan.heads(packed)
    c = x - plan.mean
    want = codes_of(c, plan.books, plan.eta)
    assert (code == want[0]).all() and np.allclose(error, want[1]) and np.allclose(along, want[2])
    number = np.zeros(side.shape[:2], np.int64)
    for k in range(side.shape[2]):
        number = number * 256 + side[:, :, k]
    assert (number + (np.arange(side.shape[1]) << TABLE_BIT) == plan.buckets(c)).all()
    wide = fit(r.normal(size=(300, d)).astype(np.float32), 10**6, reach=1.5, leaf=50, sub=8 if d == 32 else 7, eta=4.0, loss=1e-3)
    assert (wide.vectors(wide.packed(x)).view(np.uint32) == x.view(np.uint32)).all()


@pytest.mark.parametrize("most", [1, 100, 5000])
def test_small_buckets_are_scanned_together(most):
    """Of a table's buckets, as many at a time as fit: what is near, and what is nearest, is what each bucket by itself has."""
    x = made(500)
    plan = fit(x, len(x), reach=1.5, leaf=20, sub=8, eta=4.0, loss=1e-3)
    leaf = plan.buckets(x - plan.mean)[:, 0]
    split = np.where(leaf == np.unique(leaf)[-1], 1, 0)  # a bucket of which this is a block against another
    batch = pd.DataFrame({"leaf": leaf, "a": 0, "b": split, "side": np.where(split & (np.arange(500) % 2), 1, 0), "id": np.arange(500), "vec": plan.packed(x)})
    batch = batch.sort_values(["leaf", "side", "id"], ignore_index=True)
    starts = segment_starts(batch, ["leaf", "a", "b"])
    runs, segment = vectors.together(batch, starts, most)
    assert len(starts) > 20 and (len(runs) == len(starts) if most == 1 else len(runs) < len(starts))
    joined = batch.assign(segment=segment)
    ends = lambda k: zip(k, np.r_[k[1:], len(batch)], strict=True)
    near = lambda m: {(batch.id[a], batch.id[b], d) for part in vectors.nearest_of(m, 4) for a, b, d in zip(*part, strict=True)}
    alone = set().union(*[near(vectors.met_in(batch, s, e, plan, 1.5)) for s, e in ends(starts)])
    assert set().union(*[near(vectors.met_in(joined, s, e, plan, 1.5, "segment", segment[s] != segment[e - 1])) for s, e in ends(runs)]) == alone and len(alone) > 300


@pytest.mark.parametrize("n", [40, 300])
def test_scan_of_few_and_many(n):
    """The same estimates by tables and by centres."""
    x = made(300)[:n]
    plan = fit(made(300), 300, reach=1.5, leaf=50, sub=8, eta=4.0, loss=1e-3)
    code = codes_of(x - plan.mean, plan.books, plan.eta)[0]
    at = np.concatenate([plan.books[s][code[:, s]] for s in range(len(plan.books))], axis=1)
    assert np.allclose(scan(x[:30], code, plan.books), at @ x[:30].T, atol=1e-2)
