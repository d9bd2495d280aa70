"""Mosaics as islands of accepted frames, and their homographies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import carried, running

# A mosaic is discarded if it has fewer frames and has grown less.
LEAST_FRAMES, LEAST_GROWTH = 180, 1.5


def segments(log: DataFrame, inspection: str = "inspection_id", index: str = "frame_index", ok: str = "ok", growth: str = "size_increase", *, least_frames: int = LEAST_FRAMES, least_growth: float = LEAST_GROWTH, finish_open: bool = True, chunk: float = 10_000) -> DataFrame:
    """(inspection, mosaic_id, start_frame, end_frame, frames, growth, closed) of the kept mosaics.

    A frame that isn't ok closes the open mosaic and belongs to none, but is its end. The mosaic still open after
    the last frame is kept by the same rule unless ``finish_open`` is false. Rows with a null inspection or index are ignored; a null ok is not ok.
    """
    d = log.filter(F.col(inspection).isNotNull() & F.col(index).isNotNull()).withColumn("_ok", F.coalesce(F.col(ok), F.lit(False)))
    broken = (~F.col("_ok")).cast("bigint")
    d = running(d, inspection, [index], F.floor(F.col(index) / chunk), "_g", broken).withColumn("_g", F.col("_g") - broken)  # breaks before this frame
    g = d.groupBy(inspection, "_g").agg(
        F.min(F.when(F.col("_ok"), F.col(index))).alias("start_frame"), F.max(index).alias("end_frame"), F.count_if("_ok").alias("frames"),
        F.max_by(growth, F.when(F.col("_ok"), F.col(index))).alias("growth"), F.max((~F.col("_ok")).cast("int")).alias("_closed"))
    kept = (F.col("frames") > 0) & ~((F.col("frames") < least_frames) & (F.coalesce("growth", F.lit(0.0)) < least_growth))
    g = g.filter(kept).withColumn("closed", F.col("_closed") == 1)
    if not finish_open:
        g = g.filter("closed")
    return g.select(inspection, F.concat(F.lit("m"), F.col(inspection).cast("string"), F.lit("."), F.col("start_frame").cast("string")).alias("mosaic_id"), "start_frame", "end_frame", "frames", "growth", "closed")


def membership(log: DataFrame, kept: DataFrame, every: int = 30, *, chunk: float = 10_000) -> DataFrame:
    """(inspection_id, frame_index, mosaic_id): the sampled, accepted frames of the kept mosaics.

    The mosaic that began last is carried along the frames, so no frame is joined with its inspection's mosaics.
    """
    f = log.filter(F.col("ok") & (F.col("frame_index") % every == 0)).select("inspection_id", "frame_index", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_m"), F.lit(None).cast("double").alias("_e"))
    k = kept.select("inspection_id", F.col("start_frame").alias("frame_index"), F.lit(0).alias("_kind"), F.col("mosaic_id").alias("_m"), F.when(F.col("closed"), F.col("end_frame") - 1).otherwise(F.col("end_frame")).cast("double").alias("_e"))
    begun = F.when(F.col("_kind") == 0, F.struct("_m", "_e"))
    d = carried(f.unionByName(k), "inspection_id", ["frame_index", "_kind"], F.floor(F.col("frame_index") / chunk), {"_open": begun})
    return d.filter("_kind = 1 and frame_index <= _open._e").select("inspection_id", "frame_index", F.col("_open._m").alias("mosaic_id"))


def compose(steps: DataFrame, mosaic: str, index: str, matrix: str) -> DataFrame:
    """(mosaic, index, homography): running product of each mosaic's 3x3 matrices (flat, row by row).

    A mosaic is one stretch of video and bounded by it. A null matrix counts as the identity.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        h, out = np.eye(3), []
        for m in pdf[matrix]:
            h = h if m is None else h @ np.asarray(m, float).reshape(3, 3)
            out.append(h.ravel().tolist())
        return pd.DataFrame({mosaic: pdf[mosaic], index: pdf[index], "homography": out})

    kinds = dict(steps.dtypes)
    return steps.select(mosaic, index, matrix).groupBy(mosaic).applyInPandas(run, f"{mosaic} {kinds[mosaic]}, {index} {kinds[index]}, homography array<double>")


def plausible(h: np.ndarray, width: float, height: float, most_shift: float = 100.0, most_warp: float = 260.0) -> bool:
    """Whether a homography moves no corner too far and keeps the frame's form."""
    corners = np.array([[0, 0, 1], [width, 0, 1], [width, height, 1], [0, height, 1]], float).T
    p = h @ corners
    p = (p[:2] / p[2]).T
    moved = p - corners[:2].T
    shift = np.linalg.norm(moved.mean(0))
    warp = np.linalg.norm(moved - moved.mean(0), axis=1).sum()
    return bool(np.isfinite(p).all() and shift <= most_shift and warp <= most_warp)
