"""What the operators share: reading tables, cutting lineage, and running Python over whole segments."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: rows are written once to the folder that all executors share, and read from there.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the session runs in one process, as in tests,
    a temporary folder is used; on a cluster, whose machines would not see it, that raises.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Of plans that are made and run in this context, shuffle files are removed as soon as they have run, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def map_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame, np.ndarray], "pd.DataFrame | Iterator[pd.DataFrame]"], schema: str) -> DataFrame:
    """Run ``fn`` over batches that hold whole segments, sorted by ``keys`` and ``order``.

    A segment is the rows of equal ``keys``; callers bound its size by making a block number part of the
    keys, so no task ever holds an unbounded group. ``fn(batch, starts)`` gets many segments at once
    (``starts`` are their first positions), so that NumPy works across segments and not once per group; it may return its rows in parts.
    Keys must not be null.
    """
    key_list = list(keys)

    def parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = fn(batch, segment_starts(batch, key_list))
        yield from [out] if isinstance(out, pd.DataFrame) else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held:
                last = held[-1][key_list].iloc[-1]
                same = np.ones(len(batch), dtype=bool)
                for k in key_list:
                    same &= (batch[k] == last[k]).to_numpy()
                if same.all():
                    held.append(batch)
                    continue
            last_start = int(segment_starts(batch, key_list)[-1])
            if last_start:
                ready, held = [*held, batch.iloc[:last_start]], [batch.iloc[last_start:]]
            else:  # one segment that isn't the one held
                ready, held = held, [batch]
            if ready:
                yield from parts(pd.concat(ready, ignore_index=True))
        if held:
            yield from parts(pd.concat(held, ignore_index=True))

    return df.repartition(*key_list).sortWithinPartitions(*key_list, *order).mapInPandas(run, schema)


def segment_starts(batch: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(batch), dtype=bool)
    new[0] = True
    for k in keys:
        v = batch[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def padded(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments of uneven length: positions as (segments, longest) and a mask of the real ones."""
    lengths = np.diff(np.r_[starts, n])
    cols = np.arange(int(lengths.max()) if len(lengths) else 0)
    real = cols[None, :] < lengths[:, None]
    return np.where(real, starts[:, None] + cols[None, :], 0), real


def ranked_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: "F.Column", block: int, halo: int) -> DataFrame:
    """Split every group of ``keys`` into blocks of ``block`` rows by rank, each with ``halo`` rows of both neighbours.

    Adds ``idx`` (rank in the group from 0), ``block`` and ``own`` (false for rows lent from a neighbour).
    The rank needs no task that sees a whole group: rows are ranked within a ``chunk`` (any expression that
    rises with the order), and the chunks' counts, one row a chunk, are summed up before being joined back.
    Null keys or orders must have been removed.
    """
    from pyspark.sql import Window as W

    k = list(keys)
    rows = df.withColumn("_chunk", chunk)
    within = W.partitionBy(*k, "_chunk").orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(within) - 1)
    before = (
        rows.groupBy(*k, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_from", F.coalesce(F.sum("_n").over(W.partitionBy(*k).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    rows = rows.join(before, [*k, "_chunk"]).withColumn("idx", F.col("_from") + F.col("_rn")).drop("_chunk", "_rn", "_from")
    home = F.expr(f"idx div {block}")
    at = F.expr(f"idx % {block}")
    lent = F.array(
        F.struct(home.alias("block"), F.lit(True).alias("own")),
        F.when((at < halo) & (home > 0), F.struct((home - 1).alias("block"), F.lit(False).alias("own"))),
        F.when(at >= block - halo, F.struct((home + 1).alias("block"), F.lit(False).alias("own"))),
    )
    return rows.withColumn("_b", F.explode(F.filter(lent, lambda x: x.isNotNull()))).select("*", "_b.block", "_b.own").drop("_b")


def carried(df: DataFrame, source: str, order: Sequence[str], chunk: "F.Column", values: dict[str, "F.Column"], *, back: bool = False) -> DataFrame:
    """Add, for each named value, its last non-null one in the rows of the same source before this one (``back``: after it).

    Two levels, so that no task sees a whole source: windows within chunks of it, and windows over one row a chunk.
    ``chunk`` must rise with the order.
    """
    from pyspark.sql import Window as W

    turn = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))
    d = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": v for n, v in values.items()})
    within = W.partitionBy(source, "_chunk").orderBy(*[turn(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    key = F.struct(*order)
    end = (F.min_by if back else F.max_by)
    ends = d.groupBy(source, "_chunk").agg(*[end(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), key)).alias(f"_e_{n}") for n in values])
    over = W.partitionBy(source).orderBy(turn("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(source, "_chunk", *[F.last(f"_e_{n}", ignorenulls=True).over(over).alias(f"_c_{n}") for n in values])
    d = d.join(ends, [source, "_chunk"])
    return d.withColumns({n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(within), F.col(f"_c_{n}")) for n in values}).drop("_chunk", *[f"{p}{n}" for n in values for p in ("_v_", "_c_")])


def running(df: DataFrame, source: str, order: Sequence[str], chunk: "F.Column", out: str, value: "F.Column") -> DataFrame:
    """Add the running sum of a value, this row's included, over a source's rows in order; in two levels like ``carried``."""
    from pyspark.sql import Window as W

    d = df.withColumn("_chunk", chunk).withColumn("_x", value)
    within = W.partitionBy(source, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    over = W.partitionBy(source).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy(source, "_chunk").agg(F.sum("_x").alias("_s")).select(source, "_chunk", F.sum("_s").over(over).alias("_before"))
    d = d.join(sums, [source, "_chunk"])
    return d.withColumn(out, F.sum("_x").over(within) + F.coalesce("_before", F.lit(0))).drop("_chunk", "_x", "_before")
