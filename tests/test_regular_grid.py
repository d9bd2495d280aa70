from datetime import datetime, timedelta

import numpy as np
import pytest
from tidemark.operators.regular_grid import regular_grid, smooth

T0 = datetime(2022, 5, 9, 23, 59, 47)
SCHEMA = "inspection_id int, time timestamp_ntz, depth double, heading double, pitch double, slot int"


def grid(spark, rows, **kw):
    return regular_grid(spark.createDataFrame(rows, SCHEMA), source="inspection_id", time="time", **kw).toPandas()


def at(s, d=1.0, h=1.0, p=1.0, i=1):
    return (i, T0 + timedelta(seconds=s), d, h, p, 7)


def test_slots_and_missing(spark):
    g = grid(spark, [at(0), at(1, d=None, h=float("nan")), at(25, d=None), at(61)])
    d = g[g.field == "depth"].sort_values("slot")
    assert [str(x) for x in d.slot][:2] == ["2022-05-09 23:59:40", "2022-05-09 23:59:50"] and len(d) == 7
    assert d.missing.tolist() == [False, True, True, True, True, True, False]
    h = g[g.field == "heading"].sort_values("slot")
    assert h.missing.tolist() == [False, True, True, False, True, True, False]


@pytest.mark.parametrize("block", [2160, 20])
def test_filled_values(spark, block):
    r = np.random.default_rng(0)
    s = np.sort(r.uniform(0, 3000, 700))
    s = s[(s < 1000) | (s > 1060)]
    rows = [at(float(x), d=float(5 + 0.002 * x + r.normal(0, 0.02)), h=float((350 + 0.05 * x) % 360 + r.normal(0, 0.2)), p=float(np.sin(x / 200))) for x in s]
    g = grid(spark, rows, block=block, halo=15)
    x = (g.slot - T0).dt.total_seconds()
    inside = (x > 0) & (x < 2990)
    d, h = inside & (g.field == "depth"), inside & (g.field == "heading")
    assert np.abs(g.value[d] - (5 + 0.002 * x[d])).max() < 0.15
    off = (g.value[h] - (350 + 0.05 * x[h]) + 180) % 360 - 180
    assert np.abs(off).max() < 3 and g.value[h].between(0, 360).all()
    gap = d & g.missing & x.between(1010, 1050)
    assert gap.sum() >= 4 and g.sd[gap].mean() > g.sd[d & ~g.missing].mean()


def test_long_gap_and_null_times(spark):
    g = grid(spark, [at(0), at(90_000), (1, None, 1.0, 1.0, 1.0, 7), (None, T0, 1.0, 1.0, 1.0, 7), at(0), at(5, d=float("inf"), i=2)], block=100, halo=10)
    d = g[(g.field == "depth") & (g.source == 1)]
    assert len(d) == 9001 and d.missing.sum() == 8999 and d.slot.is_unique
    assert g[(g.source == 2) & (g.field == "depth")].missing.tolist() == [False]
    assert grid(spark, []).empty


def test_smoother_against_the_batch_solution():
    r = np.random.default_rng(5)
    t = np.sort(r.uniform(0, 50, 30))
    y = r.normal(0, 1, 30)
    y[[3, 10, 11]] = np.nan
    q, v = 0.01, 0.5
    n = 2 * len(t)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, 0], a[1, 1] = 1e-8, 1e-2  # prior of the filter
    for k in range(len(t)):
        if not np.isnan(y[k]):
            a[2 * k, 2 * k] += 1 / v
            b[2 * k] += y[k] / v
        if k:
            d = t[k] - t[k - 1]
            w = np.linalg.inv(q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]]))
            f = np.array([[1, d], [0, 1]])
            j = np.zeros((2, n))
            j[:, 2 * k - 2 : 2 * k], j[:, 2 * k : 2 * k + 2] = -f, np.eye(2)
            a += j.T @ w @ j
    cov = np.linalg.inv(a)
    x, var = smooth(t[None], y[None], np.ones((1, 30), bool), np.array([v]), q, None)
    assert np.allclose(x[0], (cov @ b)[::2], atol=1e-3) and np.allclose(var[0], np.diag(cov)[::2], rtol=1e-2)


def test_a_long_gap_is_filled_with_growing_uncertainty(spark):
    """Of 60 hours, far more than a block and its halos: every slot has a value, and the middle is the least certain."""
    rows = [at(10 * k, d=5.0) for k in range(60)] + [at(216_000 + 10 * k, d=9.0) for k in range(60)]
    g = grid(spark, rows)
    d = g[g.field == "depth"].sort_values("slot").reset_index(drop=True)
    gap = d[d.missing]
    assert len(gap) > 21_000 and d.value.notna().all() and d.sd.notna().all()
    assert gap.sd.iloc[len(gap) // 2] > 5 * max(gap.sd.iloc[0], gap.sd.iloc[-1])
    assert abs(d.value.iloc[30] - 5) < 0.1 and abs(d.value.iloc[-30] - 9) < 0.1
