"""Filter options and the predicates that they make."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At least one model says that the label is there.
SEEN = 0.8


@dataclass(frozen=True)
class FilterOptions:
    inspections: tuple[int, ...] | None = None  # None for all, empty for none
    defects: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    visual_similarities: float = 10.0
    telemetry_similarities: float = 1.5
    image_quality_threshold: float = 4.0
    mosaics: bool = False
    clusters: bool = True
    key_frames: bool = False
    filter_id: str = ""

    @staticmethod
    def column(label: str) -> str:
        """Column of a label as it is shown."""
        return label.strip().lower().replace(" ", "_")


def any_seen(labels: Sequence[str]) -> Column | None:
    """True where any label is seen; None for no labels."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(x) > SEEN, F.lit(False)) for x in labels]) if labels else None


def findings(opts: FilterOptions, *, ignore_quality: bool = False, quality: str = "uciqe") -> Column:
    """Quality reached, and any of the parts, and any of the defects; an empty list asks for nothing.

    A quality that is null, NaN or below 0 never passes, not even where quality is ignored.
    """
    q = F.col(quality)
    out = F.coalesce((q >= (0.0 if ignore_quality else opts.image_quality_threshold)) & ~F.isnan(q), F.lit(False))
    for c in (any_seen(opts.parts), any_seen(opts.defects)):
        out = out if c is None else out & c
    return out


def of_inspections(df: DataFrame, opts: FilterOptions, column: str = "inspection_id") -> DataFrame:
    """Rows of the chosen inspections; none chosen, no rows; None, all rows."""
    if opts.inspections is None:
        return df
    return df.filter(F.col(column).isin(*opts.inspections)) if opts.inspections else df.filter(F.lit(False))


def without_suffix(df: DataFrame, suffix: str = "coco") -> DataFrame:
    return df.select(*[c for c in df.columns if not c.endswith(suffix)])
