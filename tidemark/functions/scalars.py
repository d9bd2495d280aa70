"""Scalar functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def heading_bin(heading: Column | str, ship_heading: Column | str, *, faithful: bool = False) -> Column:
    """Sector of 30 degrees of a heading against the ship's, turned by half a turn.

    Halves are rounded up. The normalised form lies in 0 to 330; the faithful one keeps the sign of the dividend, so it
    is negative where the ship's heading exceeds the reading by more than half a turn. A null ship heading counts as 0.
    """
    x = F.floor((col(heading) - F.coalesce(col(ship_heading), F.lit(0.0)) + 180) / 30 + 0.5) * 30
    return (x % 360 if faithful else F.pmod(x, F.lit(360))).cast("int")


def detid(text: Column | str) -> Column:
    """The small id of a text: a linear function of the character sum of its MD5 digits, below a million."""
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.ascii(F.substring(F.md5(col(text).cast("binary")), i, F.lit(1))).cast("long")), F.lit(0).cast("long"), lambda a, c: a + c)
    return (F.lit(7984002041) + F.lit(46663) * total) % 1_000_000


def sanitize(x: Column | str) -> Column:
    """A finite double, 0 for null, NaN, infinities and texts that are no number."""
    d = col(x).try_cast("double")
    return F.coalesce(F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d), F.lit(0.0))


def growth_ratio(growth: Column | str, hull: Column | str) -> Column:
    """Percentage of the hull that is grown over: 0 under 0.05 % hull, at most 100."""
    g, h = F.coalesce(col(growth), F.lit(0.0)), F.coalesce(col(hull), F.lit(0.0))
    return F.least(F.when(h < 0.05, 0.0).otherwise(F.try_divide(g, h)), F.lit(1.0)) * 100


def logistic(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def softmax(xs: Column | str) -> Column:
    """Shifted by the largest, so that nothing overflows."""
    e = F.transform(col(xs), lambda x: F.exp(x - F.array_max(col(xs))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes (x, y of a corner, w, h) by their union; 0 where both are empty."""
    over = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    inter = over("x", "w") * over("y", "h")
    return F.coalesce(F.try_divide(inter, a["w"] * a["h"] + b["w"] * b["h"] - inter), F.lit(0.0))


def pixel(x: Column | str, size: int) -> Column:
    """Place in pixels of a relative coordinate."""
    return F.ceil(F.round(col(x), 8) * size)


def image_path(image: Column | str) -> Column:
    """Folder of an image by its id: mosaics begin with m."""
    return F.concat(F.when(col(image).startswith("m"), F.lit("mosaics/")).otherwise(F.lit("frames/")), col(image))


def node_id(kind: str, *keys: Column | str) -> Column:
    """Composite id of a graph node: im_, in_, m_, c_, s_ or p_s_."""
    return F.concat(F.lit(f"{kind}_"), *[x for k in keys for x in (col(k).cast("string"), F.lit("_"))][:-1])


def node_kind(node: Column | str) -> Column:
    """Kind of a node by the prefix of its id."""
    n = col(node)
    out = None
    for prefix, kind in (("im_", "frame"), ("in_", "inspection"), ("m_", "mosaic"), ("c_", "cluster"), ("p_", "part"), ("s_", "ship")):
        out = F.when(n.startswith(prefix), kind) if out is None else out.when(n.startswith(prefix), kind)
    return out


def title(name: Column | str, date: Column | str) -> Column:
    return F.concat(col(name), F.lit(" on "), col(date))


def row_id(cluster: Column | str, inspection: Column | str) -> Column:
    return F.concat(col(cluster).cast("string"), F.lit("="), col(inspection).cast("string"))


def split_row_id(row: Column | str) -> Column:
    """(cluster INT, inspection INT) of a row id; nulls where it is none."""
    part = lambda i: F.regexp_extract(col(row), r"^(-?\d+)=(-?\d+)$", i).try_cast("int")
    return F.struct(part(1).alias("cluster"), part(2).alias("inspection"))


def pseudonym(key: Column | str, names: list[str]) -> Column:
    """A name that depends on the key alone."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.conv(F.substring(F.md5(col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(len(names))) + 1).cast("int"))


def duration(seconds: Column | str) -> Column:
    s = col(seconds).cast("long")
    return F.format_string("%dh %dm %ds", F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def matrix_product(a: Column | str, b: Column | str) -> Column:
    """Product of two 3x3 matrices, each flattened row by row."""
    at = lambda i, j: F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.lit(0.0), lambda acc, k: acc + F.get(col(a), i * 3 + k) * F.get(col(b), k * 3 + j))
    return F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: at(F.floor(n / 3).cast("int"), (n % 3).cast("int")))
