import numpy as np
import pytest
from tidemark.operators.spikes import implausible

SCHEMA = "frame_id string, inspection_id int, framenumber double, depth double, heading double, roll double, rangefinder double, source string, idx int"


def rows_of(values, inspection=1, field="depth", start=0):
    out = []
    for k, v in enumerate(values):
        r = {"depth": None, "heading": None, "roll": None, "rangefinder": None} | {field: None if v is None else float(v)}
        out.append((f"{inspection}.{start + 30 * k}", inspection, float(start + 30 * k), *r.values(), "x", 1))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.id, r.field): (r.impossible, r.stuck, r.spike) for r in implausible(df, id="frame_id", source="inspection_id", order="framenumber", **kw).collect()}


def course(n, seed=0, noise=0.1):
    r = np.random.default_rng(seed)
    return 10 + np.cumsum(r.normal(0, 0.01, n)) + r.normal(0, noise, n)


@pytest.mark.parametrize("block", [4096, 50])
def test_spikes_steps_and_stuck_runs(spark, block):
    x = course(400)
    x[50] += 3  # spike of one
    x[100:103] -= 2.5  # of three
    x[150:156] += 3  # lasting change and back: no case
    x[200:] += 5  # step: no case
    x[300:306] = x[300]  # stuck
    x[340:345] = x[340]  # one too short
    got = found(spark, rows_of(x), block=block, chunk_span=30.0 * 70)
    assert {k for k, v in got.items() if v[2]} == {(f"1.{30 * k}", "depth") for k in (50, 100, 101, 102)}
    assert {k for k, v in got.items() if v[1]} == {(f"1.{30 * k}", "depth") for k in range(300, 306)}
    assert not any(v[0] for v in got.values())


def test_heading_passes_north(spark):
    x = (350 + np.arange(200) * 0.3 + np.random.default_rng(1).normal(0, 0.5, 200)) % 360
    x[100] = (x[100] + 60) % 360
    assert set(found(spark, rows_of(x, field="heading"))) == {("1.3000", "heading")}


def test_bounds_and_nulls(spark):
    x = [1.0, None, float("nan"), -0.5, 301.0, float("inf"), 0.0, 300.0, float("-inf")]
    got = found(spark, rows_of(x) + rows_of([360.0, 359.9, 0.0, -1.0], 2, "heading") + rows_of([-180.0, 180.0, 181.0], 3, "roll") + [("loose", None, None, 900.0, None, None, None, "x", 1), (None, 1, 5.0, 900.0, None, None, None, "x", 1)])
    assert {k for k, v in got.items() if v[0]} == {("1.90", "depth"), ("1.120", "depth"), ("1.150", "depth"), ("1.240", "depth"), ("2.0", "heading"), ("2.90", "heading"), ("3.60", "roll"), ("loose", "depth")}


def test_repeats_late_rows_and_ties(spark):
    x = course(120)
    x[60] += 3
    rows = rows_of(x)
    shuffled = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))] + rows[:20]
    assert set(found(spark, shuffled)) == {("1.1800", "depth")}
    stuck = [(f"t{k}", 1, 5.0, 4.0, None, None, None, "x", 1) for k in range(6)]  # one order, told apart by id
    assert len(found(spark, stuck)) == 6


def test_empty(spark):
    assert found(spark, []) == {}
