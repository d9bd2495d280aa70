"""Implausible readings: impossible values, stuck values and spikes, judged within each source.

Method. Each source's readings of a field are decomposed by undecimated wavelets, made by lifting:

* the finest detail coefficients (differences of successive readings) give the source's usual scatter, as
  their median absolute value scaled to a standard deviation;
* zero details in a row are a stuck sensor;
* at widths of one to ``widest`` readings every stretch is predicted from the course around it, halfway between the medians of ``course``
  readings before and after (a median as predictor leaves spikes out of the course). What is left of each of its
  readings are the detail coefficients; the least of them, all being of one sign, is the stretch's height. A lasting change differs from one side only, so
  a stretch that doesn't rise from both sides by at least half of its height has none.

A reading is a spike where the greatest height of a stretch that it is part of reaches ``spike``, 8, times the scatter.

Scale. Nothing sees a whole source: readings are ranked by chunk counts and worked on in blocks with a halo,
and the scatter is an aggregate with partial sums (``percentile_approx``).

Defined results. Null and NaN are no readings and are passed over. Rows without source or order can only be
judged by their bounds. Repeated rows count once. Ties in the order are broken by the id. Constant series
have no scatter and no spikes but are stuck. An empty table gives an empty result. Input columns beyond
those named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import map_segments, ranked_blocks

#: field: lowest, highest, whether the highest itself is possible, degrees of a full turn or None
FRAME_LIMITS = {"depth": (0.0, 300.0, True, None), "heading": (0.0, 360.0, False, 360.0), "roll": (-180.0, 180.0, True, None), "rangefinder": (0.0, 100.0, True, None)}


def details(x: np.ndarray, seg: np.ndarray, turn: np.ndarray, out: np.ndarray, run: int, course: int, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Finest detail, spike height and stuck flag of readings ``x``.

    seg: segment of each reading (sorted); turn: 360 or inf; out: impossible readings, left out of course and scatter.
    """
    n = len(x)
    stuck = np.zeros(n, dtype=bool)
    start = np.r_[True, (x[1:] != x[:-1]) | (seg[1:] != seg[:-1])]
    rid = np.cumsum(start) - 1
    stuck = np.bincount(rid, minlength=1)[rid] >= run
    keep = np.flatnonzero(~out)
    y, s, t = x[keep], seg[keep], turn[keep]
    m = len(y)
    d, height = np.full(n, np.nan), np.zeros(n)
    if not m:
        return d, height, stuck

    def wrap(v: np.ndarray) -> np.ndarray:
        return np.where(np.isinf(t), v, v - whole * np.floor(v / whole + 0.5))

    def shift(v: np.ndarray, k: int) -> np.ndarray:
        """The value k places on; NaN beyond the segment."""
        w = np.full(m, np.nan)
        if abs(k) < m:
            a, b = (slice(0, m - k), slice(k, m)) if k > 0 else (slice(-k, m), slice(0, m + k))
            w[a] = np.where(s[a] == s[b], v[b], np.nan)
        return w

    whole = np.where(np.isinf(t), 1.0, t)
    step = wrap(y - shift(y, -1))
    d[keep] = np.abs(step)
    u = np.cumsum(np.where(np.isnan(step), y - np.r_[0.0, y[:-1]], step)) if (~np.isinf(t)).any() else y  # the angle without its jumps at the full turn
    u = np.where(np.isinf(t), y, u)
    before = _median3([shift(u, -1 - j) for j in range(course)])
    after = _median3([shift(u, 1 + j) for j in range(course)])
    best = np.zeros(m)
    for width in range(1, widest + 1):  # stretches that begin here
        back = shift(after, width - 1)
        middle = before + wrap(back - before) / 2
        low, rise, sign = np.full(m, np.inf), np.full(m, np.inf), None
        for j in range(width):
            x_j = shift(u, j)
            detail, b_j, a_j = wrap(x_j - middle), wrap(x_j - before), wrap(x_j - back)
            sign = np.sign(detail) if sign is None else sign
            same = (np.sign(detail) == sign) & (np.sign(b_j) == sign) & (np.sign(a_j) == sign)
            low = np.minimum(low, np.where(same, np.abs(detail), 0.0))
            rise = np.minimum(rise, np.where(same, np.minimum(np.abs(b_j), np.abs(a_j)), 0.0))
        low = np.nan_to_num(np.where(rise >= 0.5 * low, low, 0.0))
        for j in range(width):
            best = np.fmax(best, np.nan_to_num(shift(low, -j)))
    height[keep] = best
    return d, height, stuck


def _median3(cols: list[np.ndarray]) -> np.ndarray:
    """Row median over the columns, passing over NaN; NaN where there is none."""
    v = np.sort(np.stack(cols, axis=1), axis=1)  # NaN last
    c = np.sum(~np.isnan(v), axis=1)
    i = np.arange(len(v))
    lo, hi = np.maximum((c - 1) // 2, 0), c // 2
    return np.where(c > 0, (v[i, lo] + v[i, np.minimum(hi, v.shape[1] - 1)]) / 2, np.nan)


def implausible(df: DataFrame, *, id: str, source: str, order: str, limits: dict[str, tuple] = FRAME_LIMITS, run: int = 6, spike: float = 8.0, course: int = 3, widest: int = 3, block: int = 4096, chunk_span: float = 60_000.0) -> DataFrame:
    """(id, field, impossible, stuck, spike, ratio) of every implausible reading. See the module's text."""
    fields = list(limits)
    rows = df.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(order).cast("double").alias("ord"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(fields)]).filter("id is not null").dropDuplicates()
    low = "CASE field " + " ".join(f"WHEN {i} THEN v < {lim[0]!r}D OR v > {lim[1]!r}D" + ("" if lim[2] else f" OR v >= {lim[1]!r}D") for i, lim in enumerate(limits.values())) + " END"
    long = rows.select("id", "source", "ord", F.expr(f"stack({len(fields)}, " + ", ".join(f"{i}, f{i}" for i in range(len(fields))) + ") as (field, v)")).filter("v is not null and not isnan(v)").withColumn("out", F.expr(low))
    placed = long.filter("source is not null and ord is not null and not isnan(ord)")
    blocks = ranked_blocks(placed, ["source", "field"], ["ord", "id"], F.floor(F.col("ord") / chunk_span), block, halo=2 * max(run, course + widest))
    turns = np.array([lim[3] or np.inf for lim in limits.values()])

    def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        seg = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(batch)]))
        d, h, stuck = details(batch.v.to_numpy(float), seg, turns[batch.field.to_numpy()], batch.out.to_numpy(bool), run, course, widest)
        own = batch.own.to_numpy(bool)
        return pd.DataFrame({"id": batch.id[own], "source": batch.source[own], "field": batch.field[own], "out": batch.out[own], "stuck": stuck[own], "height": h[own], "detail": d[own]})

    types = dict(placed.dtypes)
    seen = map_segments(blocks.select("source", "field", "block", "idx", "own", "id", "v", "out"), ["source", "field", "block"], ["idx"], work, f"id {types['id']}, source {types['source']}, field int, out boolean, stuck boolean, height double, detail double")
    return _judged(seen, long, fields, spike)


def _judged(seen: DataFrame, long: DataFrame, fields: list[str], spike: float) -> DataFrame:
    from tidemark.runtime import cut

    seen = cut(seen)
    scatter = seen.filter("detail is not null and not isnan(detail)").groupBy("source", "field").agg((F.percentile_approx("detail", 0.5, 10_000) * F.lit(1.482602218505602 / 2**0.5)).alias("scatter"))
    found = seen.filter("out or stuck or height > 0").join(scatter, ["source", "field"], "left").withColumn("ratio", F.when(F.col("scatter") > 0, F.col("height") / F.col("scatter")))
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    found = found.select("id", name.alias("field"), F.col("out").alias("impossible"), "stuck", F.coalesce(F.col("ratio") >= spike, F.lit(False)).alias("spike"), "ratio").filter("impossible or stuck or spike")
    loose = long.filter("out and (source is null or ord is null or isnan(ord))").select("id", name.alias("field"), F.lit(True).alias("impossible"), F.lit(False).alias("stuck"), F.lit(False).alias("spike"), F.lit(None).cast("double").alias("ratio"))
    return found.unionByName(loose)
