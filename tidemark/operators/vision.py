"""What is computed from scores, boxes, masks and pixels. Models themselves are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import col
from tidemark.model import LABELS

# Fixed values of the score fusion.
CLASSIFIED, SEGMENTED = 0.5, 0.01


def fuse(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """For each label the number of models (0 to 2) that see it: classification over 0.5, segmentation over 0.01. Null sees nothing."""
    point = lambda c, t: F.when((F.col(c) > t) & ~F.isnan(c), 1).otherwise(0)
    return df.withColumns({x: point(f"{x}_classification", CLASSIFIED) + point(f"{x}_segmentation", SEGMENTED) for x in labels})


def coverage(mask: Column | str, threshold: float = 0.5) -> Column:
    """Share of a mask's values over a threshold; null for an empty or null mask."""
    m = col(mask)
    return F.try_divide(F.size(F.filter(m, lambda x: x > threshold)), F.size(m))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Percentage of mask a that mask b covers; 0 where either is empty or a is blank."""
    both = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.when(x & y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    area = F.size(F.filter(col(a), lambda x: x))
    return F.coalesce(F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), F.try_divide(both * 100.0, area)), F.lit(0.0))


def label_share(labelled: Column | str, drawn: Column | str) -> Column:
    """Percentage of the drawn pixels of a mosaic that bear a label."""
    n = F.size(F.filter(F.zip_with(col(labelled), col(drawn), lambda x, y: x & y), lambda x: x))
    return F.coalesce(F.try_divide(n * 100.0, F.size(F.filter(col(drawn), lambda x: x))), F.lit(0.0))


def run_lengths(mask: np.ndarray) -> list[int]:
    """Lengths of runs of a mask column by column, beginning with the zeros."""
    v = np.asarray(mask, bool).ravel(order="F")
    edge = np.flatnonzero(np.diff(v.astype(np.int8))) + 1
    n = np.diff(np.r_[0, edge, len(v)]).tolist() if len(v) else []
    return [0, *n] if len(v) and v[0] else n


def from_run_lengths(counts: list[int], shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(shape, order="F")


def uciqe(chroma: np.ndarray, lightness: np.ndarray, saturation: np.ndarray | None = None) -> float:
    """Underwater image quality: spread of chroma, contrast of lightness and mean saturation, weighted.

    Contrast takes every n-th of the sorted lightnesses from both ends, n being one in a hundred pixels.
    """
    c, x = np.asarray(chroma, float).ravel(), np.asarray(lightness, float).ravel()
    if not len(x):
        return float("nan")
    stride = max(1, int(np.floor(0.01 * len(x) + 0.5)))
    low = np.sort(x)
    contrast = low[::-1][::stride].mean() - low[::stride].mean()
    s = np.where((c == 0) | (x == 0), 0.0, c / np.where(x == 0, 1, x)) if saturation is None else np.asarray(saturation, float).ravel()
    return float(0.468 * np.sqrt(((c - c.mean()) ** 2).mean()) + 0.2745 * contrast + 0.2576 * s.mean())


def _by_rows(df: DataFrame, columns: list[str], out: str, kind: str, fn: Callable) -> DataFrame:  # noqa: ANN001
    """``out``: fn of some array columns, row by row over Arrow batches; null where one of them is null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = b[columns].notna().all(axis=1)
            value = pd.Series([None] * len(b), dtype=object)
            value[ok.to_numpy()] = pd.Series([fn(*v) for v in zip(*(b.loc[ok, c] for c in columns), strict=True)], index=np.flatnonzero(ok), dtype=object)
            yield b.assign(**{out: value.to_numpy()})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    return df.drop(out).mapInPandas(run, f"{fields}, `{out}` {kind}")


def with_uciqe(df: DataFrame, chroma: str, lightness: str, out: str = "uciqe") -> DataFrame:
    """The quality of each image from its pixels' chroma and lightness (arrays of one length)."""
    return _by_rows(df, [chroma, lightness], out, "double", uciqe)


def with_run_lengths(df: DataFrame, mask: str, height: int, out: str = "counts") -> DataFrame:
    """The run lengths of each mask, column by column from zeros; masks are arrays row by row, of so many rows."""
    return _by_rows(df, [mask], out, "array<int>", lambda m: run_lengths(np.asarray(m, bool).reshape(height, -1)))


def decoded(df: DataFrame, grid: str, anchors: np.ndarray, classes: int, size: int) -> DataFrame:
    """(all but grid, x, y, w, h, class_probs): the boxes of each image's detector output (a flat array), for ``detections``."""
    keep = [c for c in df.columns if c != grid]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b[b[grid].notna()].itertuples(index=False):
                boxes = decode(np.asarray(getattr(r, grid), float).reshape(-1, size, size), anchors, classes)
                yield boxes.assign(**{c: getattr(r, c) for c in keep})[[*keep, "x", "y", "w", "h", "class_probs"]]

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", x double, y double, w double, h double, class_probs array<double>")


def decode(grid: np.ndarray, anchors: np.ndarray, classes: int) -> pd.DataFrame:
    """Boxes of a detector's output (anchors * (5 + classes), size, size): corner, width, height and class probabilities."""
    k, size = len(anchors), grid.shape[-1]
    g = grid.reshape(k, 5 + classes, size, size)
    sig = lambda v: 1 / (1 + np.exp(-v))
    y, x = np.mgrid[0:size, 0:size]
    w, h = (np.exp(g[:, 2 + i]) * anchors[:, i, None, None] / size for i in (0, 1))
    cx, cy = (sig(g[:, 0]) + x) / size, (sig(g[:, 1]) + y) / size
    e = np.exp(g[:, 5:] - g[:, 5:].max(1, keepdims=True))
    p = (e / e.sum(1, keepdims=True)) * sig(g[:, 4])[:, None]
    return pd.DataFrame({"x": (cx - w / 2).ravel(), "y": (cy - h / 2).ravel(), "w": w.ravel(), "h": h.ravel(), "class_probs": list(np.moveaxis(p, 1, -1).reshape(-1, classes))})


def suppress(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, probs: np.ndarray, threshold: float = 0.15, most_iou: float = 0.45, most: int = 20) -> list[tuple[int, int, float]]:
    """(box, class, probability) by greedy suppression for each class, highest first; ties go to the earlier box."""
    p, best = probs.astype(float).copy(), []
    while len(best) < most and p.size:
        i, c = np.unravel_index(p.argmax(), p.shape)
        if not p[i, c] >= threshold:
            break
        best.append((int(i), int(c), float(p[i, c])))
        iw = np.maximum(np.minimum(x + w, x[i] + w[i]) - np.maximum(x, x[i]), 0)
        ih = np.maximum(np.minimum(y + h, y[i] + h[i]) - np.maximum(y, y[i]), 0)
        union = w * h + w[i] * h[i] - iw * ih
        p[np.where(union > 0, iw * ih / np.where(union > 0, union, 1), 0) > most_iou, c] = 0
        p[i, c] = 0  # the box may be chosen again for another class
    return best


def detections(boxes: DataFrame, image: str = "image_id", **limits: float) -> DataFrame:
    """(image, box, class, probability, x, y, w, h) kept of each image's boxes (bounded by the detector's grid)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "w", "h"]).reset_index(drop=True)
        kept = suppress(*(pdf[c].to_numpy(float) for c in "xywh"), np.stack(pdf.class_probs.to_numpy()), **limits)
        at = [k[0] for k in kept]
        return pd.DataFrame({image: pdf[image].iloc[at].to_numpy(), "box": at, "class": [k[1] for k in kept], "probability": [k[2] for k in kept]} | {c: pdf[c].iloc[at].to_numpy(float) for c in "xywh"})

    return boxes.na.drop().groupBy(image).applyInPandas(run, f"{image} {dict(boxes.dtypes)[image]}, box int, class int, probability double, x double, y double, w double, h double")


def score(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Score batches by a model that each worker loads once; ``load`` returns a function from batch to result."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)
