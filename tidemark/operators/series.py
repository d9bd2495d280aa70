"""Telemetry series: one row an instant, unwrapped angles, even resampling, decimation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import carried, running

#: Length of the chunks of time in which a source is worked on, in microseconds.
CHUNK_US = 3.6e9


def one_per_instant(df: DataFrame, source: str, time: str, order: Sequence[str]) -> DataFrame:
    """The first row of each instant of a source, by ``order``."""
    w = W.partitionBy(source, time).orderBy(*order)
    return df.filter(F.col(source).isNotNull() & F.col(time).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unwrap(df: DataFrame, source: str, time: str, angle: str, out: str = "unwrapped", *, chunk: float = CHUNK_US) -> DataFrame:
    """Angles in degrees without jumps at the full turn. A step of exactly half a turn goes down. Nulls and NaN are left out of the course and stay null.

    ``time`` is a number, one row for each in a source; rows with a null source are dropped. A source is worked on in chunks of time.
    """
    part = F.floor(F.col(time) / chunk)
    d = df.filter(F.col(source).isNotNull() & F.col(time).isNotNull()).withColumn("_a", F.when(~F.isnan(angle), F.col(angle)))
    d = carried(d, source, [time], part, {"_last": F.col("_a")})
    step = F.when(F.col("_last").isNull(), F.col("_a")).otherwise(F.pmod(F.col("_a") - F.col("_last") + 180, F.lit(360.0)) - 180)
    d = running(d, source, [time], part, "_sum", F.coalesce(step, F.lit(0.0)))
    return d.withColumn(out, F.when(F.col("_a").isNotNull(), F.col("_sum"))).drop("_a", "_last", "_sum")


def resample(df: DataFrame, source: str, us: str, fields: Sequence[str], n: int, angles: Sequence[str] = (), *, chunk: float = CHUNK_US) -> DataFrame:
    """(source, frame_index, us, fields): ``n`` instants evenly from a source's first to its last, interpolated by time.

    ``us`` is the time in microseconds, one row for each. Before a field's first value it is null, after its last the last.
    Angles are unwrapped for it and come out within 0 to 360. Each reading makes the instants of the interval up to the next
    one, so no join of all instants with all readings is needed. A source is worked on in chunks of time.
    """
    for a in angles:
        df = unwrap(df, source, us, a, a, chunk=chunk)
    df = df.filter(F.col(source).isNotNull() & F.col(us).isNotNull()).select(source, us, *fields)
    part = F.floor(F.col(us) / chunk)
    point = {f: F.when(F.col(f).isNotNull() & ~F.isnan(f), F.struct(F.col(us).alias("t"), F.col(f).alias("v"))) for f in fields}
    d = carried(df, source, [us], part, {f"_p_{f}": p for f, p in point.items()})
    d = d.withColumns({f"_p_{f}": F.coalesce(p, F.col(f"_p_{f}")) for f, p in point.items()})
    d = carried(d, source, [us], part, {f"_n_{f}": p for f, p in point.items()} | {"_next": F.col(us)}, back=True)
    d = d.join(df.groupBy(source).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi")), source)
    step = (F.col("_hi") - F.col("_lo")) / (n - 1) if n > 1 else F.lit(0.0)
    at = lambda t: F.when(F.col("_hi") > F.col("_lo"), F.ceil((t - F.col("_lo")) * (n - 1) / (F.col("_hi") - F.col("_lo")))).otherwise(F.lit(0))
    begin, end = at(F.col(us)), F.when(F.col("_next").isNull(), F.lit(n - 1)).otherwise(at(F.col("_next")) - 1)
    d = d.withColumn("_k", F.explode(F.when(end >= begin, F.sequence(begin, end)).otherwise(F.array().cast("array<bigint>")))).withColumn("_t", F.col("_lo") + F.col("_k") * step)
    out = []
    for f in fields:
        p, q = F.col(f"_p_{f}"), F.col(f"_n_{f}")
        v = F.when(q.isNull(), p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * (F.col("_t") - p["t"]) / (q["t"] - p["t"]))
        out.append((F.pmod(v, F.lit(360.0)) if f in angles else v).alias(f))
    return d.select(source, F.col("_k").alias("frame_index"), F.col("_t").alias("us"), *out)


def decimate(df: DataFrame, index: str, step: int = 30) -> DataFrame:
    return df.filter(F.col(index) % step == 0)


def flag_runs(df: DataFrame, source: str, order: str, flag: str, *, chunk: float = 10_000) -> DataFrame:
    """(source, run, flag, start, length) of the runs of equal flags in a source's order; null counts as false.

    ``order`` is a number; rows with a null in source or order are dropped. A source is worked on in chunks of ``chunk``.
    """
    part = F.floor(F.col(order) / chunk)
    d = df.select(source, order, F.coalesce(F.col(flag), F.lit(False)).alias("flag")).filter(F.col(source).isNotNull() & F.col(order).isNotNull())
    d = carried(d, source, [order], part, {"_last": F.col("flag")})
    d = running(d, source, [order], part, "run", (F.coalesce(F.col("_last") != F.col("flag"), F.lit(True))).cast("bigint"))
    return d.groupBy(source, "run").agg(F.first("flag").alias("flag"), F.min(order).alias("start"), F.count(F.lit(1)).alias("length"))
