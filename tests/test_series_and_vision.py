import numpy as np
import pandas as pd
import pytest
from tidemark.operators import mosaics as M
from tidemark.operators import series as T
from tidemark.operators import vision as V


@pytest.mark.parametrize("chunk", [3.6e9, 15e6])
def test_unwrap_and_resample(spark, chunk):
    t = [0, 10, 20, 30, 60]
    d = spark.createDataFrame([(1, x * 1_000_000, h, z) for x, h, z in zip(t, [350.0, 10.0, None, 20.0, 340.0], [None, 2.0, 4.0, float("nan"), 10.0])] + [(2, 5, 90.0, 1.0)], "s int, us bigint, heading double, depth double")
    u = [r.unwrapped for r in T.unwrap(d, "s", "us", "heading", chunk=chunk).filter("s = 1").orderBy("us").collect()]
    assert u == [350.0, 370.0, None, 380.0, 340.0]
    r = T.resample(d, "s", "us", ["heading", "depth"], 7, ["heading"], chunk=chunk).filter("s = 1").orderBy("frame_index").collect()
    assert [x.frame_index for x in r] == list(range(7)) and [x.us for x in r] == [10_000_000.0 * k for k in range(7)]
    assert np.allclose([x.heading for x in r], [350, 10, 15, 20, 20 - 40 / 3, (20 - 80 / 3) % 360, 340])
    assert r[0].depth is None and np.allclose([x.depth for x in r[1:]], [2, 4, 5.5, 7, 8.5, 10])
    assert T.resample(d, "s", "us", ["depth"], 7).filter("s = 2").count() == 7
    assert T.resample(d.limit(0), "s", "us", ["depth"], 7).count() == 0


def test_one_per_instant(spark):
    d = spark.createDataFrame([(1, 0, 2.0), (1, 0, 1.0), (None, 0, 1.0), (1, None, 1.0)], "s int, us bigint, depth double")
    assert [(r.s, r.us, r.depth) for r in T.one_per_instant(d, "s", "us", ["depth"]).collect()] == [(1, 0, 1.0)]


def test_mosaic_rules(spark):
    rows = []
    for ins, n, growth in ((1, 179, 1.4), (2, 179, 1.6), (3, 180, 1.0)):
        rows += [(ins, k, True, growth) for k in range(n)] + [(ins, n, False, 0.0), (ins, n + 1, None, 0.0), (ins, n + 2, True, 2.0)]
    log = spark.createDataFrame(rows, "inspection_id int, frame_index bigint, ok boolean, size_increase double")
    got = {(r.inspection_id, r.start_frame): r for r in M.segments(log).collect()}
    assert set(got) == {(1, 181), (2, 0), (2, 181), (3, 0), (3, 182)} and got[3, 0].end_frame == 180 and got[3, 0].frames == 180 and got[2, 181].closed is False
    assert {(r.inspection_id, r.start_frame) for r in M.segments(log, finish_open=False).collect()} == {(2, 0), (3, 0)}
    m = M.membership(log, M.segments(log)).collect()
    assert {r.frame_index for r in m if r.inspection_id == 3} == {0, 30, 60, 90, 120, 150}


def test_homographies(spark):
    a, b = [1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0]
    d = spark.createDataFrame([("m", 0, a), ("m", 1, b), ("m", 2, None)], "mosaic string, n int, h array<double>")
    got = [r.homography for r in M.compose(d, "mosaic", "n", "h").orderBy("n").collect()]
    assert got[1] == [1, 0, 2, 0, 1, 3, 0, 0, 1] == got[2]
    assert M.plausible(np.eye(3), 320, 256) and not M.plausible(np.array([[1, 0, 200], [0, 1, 0], [0, 0, 1.0]]), 320, 256)


def test_masks():
    m = np.random.default_rng(0).random((5, 7)) > 0.5
    c = V.run_lengths(m)
    assert sum(c) == 35 and (V.from_run_lengths(c, (5, 7)) == m).all()
    assert V.run_lengths(np.ones((2, 2))) == [0, 4] and V.run_lengths(np.zeros((2, 2))) == [4] and V.run_lengths(np.zeros((0, 0))) == []


def test_shares(spark):
    d = spark.createDataFrame([([True, False], [True, True]), ([False, False], [True, True]), ([], [])], "a array<boolean>, b array<boolean>")
    assert [tuple(r) for r in d.select(V.overlap("a", "b"), V.overlap("b", "a"), V.label_share("a", "b")).collect()] == [(100.0, 50.0, 50.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_suppression(spark):
    x, y = np.array([0, 0.1, 5, 5]), np.zeros(4)
    w = h = np.ones(4)
    p = np.array([[0.9, 0.0], [0.8, 0.7], [0.5, 0.1], [0.1, 0.1]])
    assert V.suppress(x, y, w, h, p) == [(0, 0, 0.9), (1, 1, 0.7), (2, 0, 0.5)]
    far = np.array([0.0, 9.0])  # a box may be chosen for several classes
    assert V.suppress(far, far * 0, far * 0 + 1, far * 0 + 1, np.array([[0.9, 0.8], [0.1, 0.1]])) == [(0, 0, 0.9), (0, 1, 0.8)]
    assert V.suppress(x[:0], y[:0], w[:0], h[:0], p[:0]) == []
    d = spark.createDataFrame([("i", float(x[k]), 0.0, 1.0, 1.0, p[k].tolist()) for k in range(4)] + [("j", None, 0.0, 1.0, 1.0, [1.0])], "image_id string, x double, y double, w double, h double, class_probs array<double>")
    assert [(r["class"], r.probability) for r in V.detections(d).collect()] == [(0, 0.9), (1, 0.7), (0, 0.5)]
    b = V.decode(np.zeros((2 * 7, 3, 3)), np.array([[1.0, 1.0], [2.0, 1.0]]), 2)
    assert len(b) == 18 and np.allclose(b.x[0] + b.w[0] / 2, 0.5 / 3) and np.allclose(b.class_probs[0], [0.25, 0.25])


def test_uciqe_and_scoring(spark):
    assert V.uciqe(np.zeros(300), np.full(300, 5.0)) == 0.0 and np.isnan(V.uciqe([], []))
    assert abs(V.uciqe([3, 4], [1, 2]) - (0.468 * 0.5 + 0.2745 * 0 + 0.2576 * 2.5)) < 1e-9
    got = V.score(spark.range(5), lambda: lambda b: pd.DataFrame({"s": b.id * 2.0}), "s double").collect()
    assert sorted(r.s for r in got) == [0, 2, 4, 6, 8]


def test_fusion(spark):
    d = spark.createDataFrame([(0.5, 0.01), (0.51, 0.011), (None, float("nan"))], "anode_classification double, anode_segmentation double")
    assert [r.anode for r in V.fuse(d, ("anode",)).collect()] == [0, 2, 0]


@pytest.mark.parametrize("chunk", [10_000, 3])
def test_runs_and_islands_across_chunks(spark, chunk):
    flags = [1, 1, 0, None, 1, 1, 1, 1, 0, 1]
    d = spark.createDataFrame([("a", k, None if f is None else bool(f)) for k, f in enumerate(flags)], "s string, n int, f boolean")
    got = sorted((r.start, r.flag, r.length) for r in T.flag_runs(d, "s", "n", "f", chunk=chunk).collect())
    assert got == [(0, True, 2), (2, False, 2), (4, True, 4), (8, False, 1), (9, True, 1)]
    log = d.selectExpr("1 as inspection_id", "n as frame_index", "f as ok", "2.0 as size_increase")
    assert sorted((r.start_frame, r.end_frame, r.frames) for r in M.segments(log, chunk=chunk).collect()) == [(0, 2, 2), (4, 8, 4), (9, 9, 1)]


def test_arrays_of_pixels_masks_and_grids(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 2.0], [0.0, 0.0]), (2, None, [1.0, 1.0], [1.0, 0.0]), (3, [1.0, 1.0], [0.0, 0.0], None)], "id int, c array<double>, l array<double>, m array<double>")
    got = {r.id: r.uciqe for r in V.with_uciqe(d, "c", "l").collect()}
    assert abs(got[1] - (0.468 * 0.5 + 0.2576 * 2.5)) < 1e-9 and got[2] is None and got[3] == 0.0
    assert {r.id: r.counts for r in V.with_run_lengths(d, "m", 1).collect()} == {1: [2], 2: [0, 1, 1], 3: None}
    g = spark.createDataFrame([("i", [0.0] * 126), ("j", None)], "image_id string, grid array<double>")
    boxes = V.decoded(g, "grid", np.array([[1.0, 1.0], [2.0, 1.0]]), 2, 3)
    assert boxes.count() == 18 and V.detections(boxes).filter("image_id = 'i'").count() > 0
    assert V.with_uciqe(d.limit(0), "c", "l").count() == 0
