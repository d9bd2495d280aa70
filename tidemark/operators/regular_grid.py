"""Irregular readings onto a regular grid, by a Kalman smoother per source.

Method. A continuous-time local linear trend (level and slope, the slope a random walk) is filtered forward
over readings and grid times together and smoothed backward (Rauch-Tung-Striebel); the smoothed level at each
grid time is the filled value, its variance the uncertainty. A slot in which no row has a value of the field
is marked missing. Angles are followed around the turn: innovations are wrapped to half a turn.

The two variances come from the readings of the block: observation noise from the robust scatter of
differences from neighbours, the slope's drift from ``drift`` (per field, units per second^1.5).

Scale. A source is cut into blocks of ``block`` slots, and a block also gets the readings of ``halo`` slots on
either side, so no task holds a whole source; a block's Kalman pass runs over all its segments at once.
Where a field's last reading before a block, or its next one after it, lies beyond the halo, the block gets it and up to ``lend`` - 1 more
behind it, however far away: which ones they are is known from one row a block. So a gap of any length is filled, with the uncertainty that
it has; the level is null only for a source that has no reading of the field at all.

Defined results. Rows with a null source or time take no part; fields null, NaN (no reading) or infinite (a
value, so not missing, but not used to smooth). Repeats of a time all count as readings. The grid of a source
runs from the slot of its first row to that of its last, readings or not. An empty table gives no slots.
Columns beyond those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import map_segments, padded

TELEMETRY_DRIFT = {"depth": 0.01, "heading": 0.3, "pitch": 0.1}


def smooth(t: np.ndarray, y: np.ndarray, real: np.ndarray, r: np.ndarray, q: float, turn: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance. All arguments are (segments, steps); y is NaN where nothing is observed.

    r: observation variance of each segment; q: spectral density of the slope's noise.
    """
    n, m = t.shape
    lvl, slp = np.zeros(n), np.zeros(n)
    p00, p01, p11 = np.full(n, 1e8), np.zeros(n), np.full(n, 1e2)
    begun = np.zeros(n, dtype=bool)
    F_ = np.empty((m, 5, n))  # filtered
    P_ = np.empty((m, 5, n))  # predicted
    D_ = np.empty((m, n))
    last = t[:, 0]
    for k in range(m):
        live = real[:, k]
        dt = np.where(live, t[:, k] - last, 0.0)
        last = np.where(live, t[:, k], last)
        lvl = lvl + dt * slp
        p00, p01, p11 = p00 + dt * (2 * p01 + dt * p11) + q * dt**3 / 3, p01 + dt * p11 + q * dt**2 / 2, p11 + q * dt
        P_[k], D_[k] = (lvl, slp, p00, p01, p11), dt
        obs = y[:, k]
        seen = live & ~np.isnan(obs)
        first = seen & ~begun
        v = np.where(seen, obs - lvl, 0.0)
        if turn:
            v = np.where(first, v, v - turn * np.floor(v / turn + 0.5))
        begun |= seen
        s = p00 + r
        k0, k1 = np.where(seen, p00 / s, 0.0), np.where(seen, p01 / s, 0.0)
        lvl, slp = lvl + k0 * v, slp + k1 * v
        p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
        F_[k] = (lvl, slp, p00, p01, p11)
    out, var = np.empty((m, n)), np.empty((m, n))
    sl, ss, s00, s01, s11 = F_[m - 1]
    out[m - 1], var[m - 1] = sl, s00
    for k in range(m - 2, -1, -1):
        fl, fs, f00, f01, f11 = F_[k]
        pl, ps, q00, q01, q11 = P_[k + 1]
        dt = D_[k + 1]
        det = np.maximum(q00 * q11 - q01 * q01, 1e-300)
        a00, a01, a10, a11 = f00 + dt * f01, f01, f01 + dt * f11, f11  # P F'
        g00, g01 = (a00 * q11 - a01 * q01) / det, (a01 * q00 - a00 * q01) / det
        g10, g11 = (a10 * q11 - a11 * q01) / det, (a11 * q00 - a10 * q01) / det
        e0, e1 = sl - pl, ss - ps
        d00, d01, d11 = s00 - q00, s01 - q01, s11 - q11
        sl, ss = fl + g00 * e0 + g01 * e1, fs + g10 * e0 + g11 * e1
        s00n = f00 + g00 * (g00 * d00 + g01 * d01) + g01 * (g00 * d01 + g01 * d11)
        s01n = f01 + g10 * (g00 * d00 + g01 * d01) + g11 * (g00 * d01 + g01 * d11)
        s11n = f11 + g10 * (g10 * d00 + g11 * d01) + g11 * (g10 * d01 + g11 * d11)
        s00, s01, s11 = s00n, s01n, s11n
        out[k], var[k] = sl, s00
    none = ~begun
    out[:, none], var[:, none] = np.nan, np.nan
    return out.T, np.maximum(var.T, 0.0)


def regular_grid(df: DataFrame, *, source: str, time: str, fields: dict[str, float] = TELEMETRY_DRIFT, turns: dict[str, float] = {"heading": 360.0}, step_s: int = 10, block: int = 2160, halo: int = 180, lend: int = 8) -> DataFrame:
    """(source, field, slot, value, sd, missing): one row for each slot of each source and field. See the module's text."""
    names = list(fields)
    step = step_s * 1_000_000
    us = F.unix_micros(F.col(time).cast("timestamp")) if dict(df.dtypes)[time] == "timestamp" else F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{time}`)")
    rows = df.select(F.col(source).alias("source"), us.alias("us"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(names)]).filter("source is not null and us is not null").withColumn("slot", F.expr(f"us div {step} - if(us % {step} < 0, 1, 0)"))
    place = F.floor(F.col("slot") / block)
    near = F.array_distinct(F.array(place, F.floor((F.col("slot") - halo) / block), F.floor((F.col("slot") + halo) / block)))
    held = rows.withColumn("block", F.explode(near)).select("source", "block", F.lit(1).alias("kind"), "us", *[f"f{i}" for i in range(len(names))], F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    held = held.unionByName(_lent(rows, len(names), block, halo, step, lend))
    bounds = rows.groupBy("source").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    heads = bounds.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)))).select(
        "source", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("us"), *[F.lit(None).cast("double").alias(f"f{i}") for i in range(len(names))],
        F.greatest("lo", F.col("block") * block).alias("lo"), F.least("hi", F.col("block") * block + block - 1).alias("hi"))

    def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n = len(batch)
        seg = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        kind = batch.kind.to_numpy()
        headed = kind[starts] == 0  # rows lent to a block in which the source has no slot are dropped
        lo, hi = batch.lo.to_numpy()[starts], batch.hi.to_numpy()[starts]
        src, blk = batch.source.to_numpy()[starts], batch.block.to_numpy()[starts]
        count = np.where(headed, hi - lo + 1, 0)
        if not count.sum():
            return pd.DataFrame({"source": [], "field": [], "slot": [], "value": [], "sd": [], "missing": []}, dtype=object)
        gseg = np.repeat(np.arange(len(starts)), count)
        gslot = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        r = (kind == 1) & headed[seg]
        us = batch.us.to_numpy()[r]
        rseg = seg[r]
        all_seg = np.r_[gseg, rseg]
        all_us = np.r_[gslot * step, us]
        is_grid = np.r_[np.ones(len(gseg), bool), np.zeros(len(rseg), bool)]
        o = np.lexsort((is_grid, all_us, all_seg))
        sseg, sus, sgrid = all_seg[o], all_us[o], is_grid[o]
        st = np.flatnonzero(np.r_[True, sseg[1:] != sseg[:-1]])
        pos, real = padded(st, len(o))
        t = (sus[pos] - sus[st][:, None]) / 1e6
        rslot = us // step
        width = np.int64(1) << 40
        out = []
        for i, name in enumerate(names):
            v = batch[f"f{i}"].to_numpy(float)[r]
            full = np.unique(rseg[~np.isnan(v)] * width + rslot[~np.isnan(v)] - (-(np.int64(1) << 39)))
            missing = ~np.isin(gseg * width + gslot - (-(np.int64(1) << 39)), full, assume_unique=False)
            y = np.r_[np.full(len(gseg), np.nan), np.where(np.isfinite(v), v, np.nan)][o]
            turn = turns.get(name)
            val, var = smooth(t, np.where(real, y[pos], np.nan), real, _noise(y, sseg, st, turn), fields[name] ** 2, turn)
            level = np.full(len(o), np.nan)
            spread = np.full(len(o), np.nan)
            level[pos[real]], spread[pos[real]] = val[real], np.sqrt(var[real])
            back_l, back_s = np.empty(len(o)), np.empty(len(o))
            back_l[o], back_s[o] = level, spread
            g = back_l[: len(gseg)]
            out.append(pd.DataFrame({"source": src[gseg], "field": name, "slot": pd.to_datetime(gslot * step, unit="us"), "value": g % turn if turn else g, "sd": back_s[: len(gseg)], "missing": missing}))
        return pd.concat(out, ignore_index=True)

    schema = f"source {dict(rows.dtypes)['source']}, field string, slot timestamp_ntz, value double, sd double, missing boolean"
    return map_segments(held.unionByName(heads), ["source", "block"], ["kind", "us"], work, schema)


def _lent(rows: DataFrame, fields: int, block: int, halo: int, step: int, lend: int) -> DataFrame:
    """The readings that blocks without readings near get from afar, as rows of those blocks."""
    reading = lambda i: F.when(F.col(f"f{i}").isNotNull() & ~F.isnan(f"f{i}") & (F.abs(f"f{i}") != float("inf")), F.col("us"))
    here = rows.groupBy("source", F.floor(F.col("slot") / block).alias("block")).agg(
        *[f(reading(i)).alias(f"{n}{i}") for i in range(fields) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    span = here.groupBy("source").agg(F.min("block").alias("a"), F.max("block").alias("b"))
    every = span.select("source", F.explode(F.sequence("a", "b")).alias("block")).join(here, ["source", "block"], "left")
    by = W.partitionBy("source").orderBy("block")
    past, future = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(1, W.unboundedFollowing)
    begin, end = (F.col("block") * block - halo) * step, ((F.col("block") + 1) * block + halo) * step
    far = []
    for i in range(fields):
        last, next_ = F.max(f"hi{i}").over(past), F.min(f"lo{i}").over(future)
        for at, is_far, back in ((last, last < begin, True), (next_, next_ >= end, False)):
            far.append(F.when(is_far, F.struct(F.lit(i).alias("i"), F.lit(back).alias("back"), at.alias("at"))))
    want = every.select("source", F.col("block").alias("to"), F.array(*far).alias("far")).select("source", "to", F.explode(F.filter("far", lambda x: x.isNotNull())).alias("w"))
    want = want.select("source", "to", "w.*", F.floor(F.col("at") / (step * block)).alias("block"))
    near = rows.withColumn("block", F.floor(F.col("slot") / block)).join(want, ["source", "block"])
    value = F.coalesce(*[F.when(F.col("i") == i, F.when(reading(i).isNotNull(), F.col(f"f{i}"))) for i in range(fields)])
    near = near.withColumn("v", value).filter(F.col("v").isNotNull() & F.when(F.col("back"), F.col("us") <= F.col("at")).otherwise(F.col("us") >= F.col("at")))
    rank = F.row_number().over(W.partitionBy("source", "to", "i", "back").orderBy(F.abs(F.col("us") - F.col("at")), "v"))
    near = near.withColumn("_r", rank).filter(F.col("_r") <= lend)
    zero = F.lit(0).cast("long")
    return near.select("source", F.col("to").alias("block"), F.lit(1).alias("kind"), "us", *[F.when(F.col("i") == i, F.col("v")).alias(f"f{i}") for i in range(fields)], zero.alias("lo"), zero.alias("hi"))


def _noise(y: np.ndarray, seg: np.ndarray, starts: np.ndarray, turn: float | None) -> np.ndarray:
    """Observation variance of each segment, from the median absolute difference of successive readings."""
    ok = np.flatnonzero(~np.isnan(y))
    d = np.diff(y[ok])
    if turn:
        d = d - turn * np.floor(d / turn + 0.5)
    same = seg[ok][1:] == seg[ok][:-1]
    med = pd.Series(np.abs(d[same])).groupby(seg[ok][1:][same]).median()
    return np.maximum(med.reindex(seg[starts]).fillna(1.0).to_numpy() * 1.4826 / 2**0.5, 1e-3) ** 2
