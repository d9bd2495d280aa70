"""The mosaic builder and sessions over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.mosaics import LEAST_FRAMES, LEAST_GROWTH


def stream_segments(log: DataFrame, *, least_frames: int = LEAST_FRAMES, least_growth: float = LEAST_GROWTH) -> DataFrame:
    """(inspection_id, start_frame, end_frame, frames, growth) of each kept mosaic, as soon as a frame closes it.

    ``log`` is a stream of (inspection_id, frame_index, ok, size_increase) whose batches hold an inspection's frames in
    turn. State is the open mosaic of each inspection: four numbers.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, frames, growth = state.get if state.exists else (None, 0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values("frame_index")
        for r in rows.itertuples():
            if r.ok:
                start, frames, growth = (r.frame_index if start is None else start), frames + 1, float(r.size_increase)
            elif start is not None:
                if not (frames < least_frames and growth < least_growth):
                    out.append((key[0], start, r.frame_index, frames, growth))
                start, frames, growth = None, 0, 0.0
        state.update((start, frames, growth))
        yield pd.DataFrame(out, columns=["inspection_id", "start_frame", "end_frame", "frames", "growth"])

    return log.select("inspection_id", "frame_index", "ok", "size_increase").groupBy("inspection_id").applyInPandasWithState(
        run, "inspection_id int, start_frame bigint, end_frame bigint, frames bigint, growth double", "start bigint, frames bigint, growth double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, time: str, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, count) of sessions that end after a gap; works on streams (with a watermark) and on tables."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("count")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def windows(events: DataFrame, time: str, key: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, count) of tumbling or sliding windows."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(key, F.window(time, size, slide or size).alias("w")).agg(F.count(F.lit(1)).alias("count")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
