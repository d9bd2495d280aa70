"""Mixed timestamp notations and zones to one UTC instant or calendar day.

Method. A text is turned into its shape mask (every digit 9, every letter a). All texts of one mask have
their parts at the same places, so a mask is mapped to a parser once (``parser_of``, kept per worker), and
the parser converts all texts of its mask at once: digits by slices of a character matrix, zone names and
months by their distinct values. Local times become UTC by the zone's transition table, which is made once on
the driver: from the transitions that the zone database lists, and where its list ends from the rule that it gives, over one
cycle of the calendar (400 years), which repeats. The database's version goes with every instant.

Rules. A stated zone or offset wins over the source's zone. Dotted dates are day first, dates with slashes
that begin with a year are year first, others follow the source's order; years of two digits are 20xx. A
local time that a change of clocks skips is not real and gives null; one that occurs twice gives both
instants, of which ``settle`` takes the one that fits the even run of the other instants of its file.

Defined results. Null, empty, blank or unusable text, days that don't exist and unknown zones give null.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib.resources import files
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

# Abbreviations of zones as offsets from UTC in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Beginnings of month names, English first.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "mai": 5, "okt": 10, "dez": 12, "des": 12, "mär": 3}

DAY_MS = 86_400_000
NONE = np.iinfo(np.int64).min


def shape(text: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text))


#: Seconds of the calendar's cycle of 400 years; after the last year of a zone's table its changes repeat.
CYCLE = 146_097 * 86_400


@dataclass(frozen=True)
class ZoneTable:
    """Offsets (seconds) of a zone: off[i] holds from at[i] (UTC seconds) on; what lies after ``end`` is as it was some cycles before."""

    at: np.ndarray
    off: np.ndarray
    end: int

    def offset(self, utc: np.ndarray) -> np.ndarray:
        over = np.maximum(utc - self.end + CYCLE - 1, 0) // CYCLE
        return self.off[np.searchsorted(self.at, utc - over * CYCLE, side="right") - 1]


def zone_version() -> str:
    """The version of the zone database that the tables are made from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        for p in ("/usr/share/zoneinfo/+VERSION", "/usr/share/zoneinfo/tzdata.zi"):
            if Path(p).exists():
                with open(p) as f:
                    return f.readline().strip().removeprefix("# version ")
        return "unknown"


def _listed(name: str) -> list[int] | None:
    """The instants of a zone's changes that the database's file lists, in UTC seconds; None where there is no such file."""
    for base in TZPATH:
        path = Path(base, name)
        if path.is_file():
            data = path.read_bytes()
            break
    else:
        try:
            data = files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
        except (ImportError, OSError):
            return None
    at, size = 0, 4
    counts = struct.unpack(">6l", data[20:44])
    if data[4:5] >= b"2":  # a second block with times of 64 bits follows the first
        ut, std, leap, times, kinds, chars = counts
        at = 44 + times * 5 + kinds * 6 + chars + leap * 8 + std + ut
        counts, size = struct.unpack(">6l", data[at + 20 : at + 44]), 8
    return list(struct.unpack(f">{counts[3]}{'q' if size == 8 else 'l'}", data[at + 44 : at + 44 + counts[3] * size]))


@lru_cache(maxsize=64)
def zone_table(name: str) -> ZoneTable | None:
    try:
        z = ZoneInfo(name)
    except Exception:  # noqa: BLE001 - an unknown or malformed name
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    off = lambda s: int((epoch + timedelta(seconds=int(s))).astimezone(z).utcoffset().total_seconds())
    year = lambda y: int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    listed = _listed(name)
    at = [np.iinfo(np.int64).min // 4]
    offs = [off(year(2))]
    for t in [t for t in listed or [] if t > year(2)]:
        at.append(t)
        offs.append(off(t))
    begin = max(listed[-1] if listed else year(1800), year(1800))
    end = begin + CYCLE + 366 * 86_400
    for lo in range(begin, end, 7 * 86_400):  # by the rule, whose changes are months apart
        hi = lo + 7 * 86_400
        while off(hi) != offs[-1]:
            a, b = lo, hi
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if off(mid) == offs[-1] else (a, mid)
            at.append(b)
            offs.append(off(b))
            lo = b
    return ZoneTable(np.array(at, dtype=np.int64), np.array(offs, dtype=np.int64), end)


def to_utc(local_ms: np.ndarray, zone: ZoneTable) -> tuple[np.ndarray, np.ndarray]:
    """Earlier and later instant of a zone's local times; equal where there is one, NONE where there is none."""
    sec = local_ms // 1000
    a, b = zone.offset(sec - 86400), zone.offset(sec + 86400)  # before and after any change nearby
    ua, ub = sec - a, sec - b
    va, vb = zone.offset(ua) == a, zone.offset(ub) == b
    ms = local_ms - sec * 1000
    ua, ub = ua * 1000 + ms, ub * 1000 + ms
    lo = np.where(va & vb, np.minimum(ua, ub), np.where(va, ua, np.where(vb, ub, NONE)))
    hi = np.where(va & vb, np.maximum(ua, ub), lo)
    return lo, hi


_DATE = [
    ("9{4}-9{1,2}-9{1,2}", "ymd"), ("9{4}/9{1,2}/9{1,2}", "ymd"), (r"9{4}\.9{1,2}\.9{1,2}", "ymd"), ("9{1,2}/9{1,2}/9{4}", "?"), ("9{1,2}/9{1,2}/9{2}", "?"),
    (r"9{1,2}\.9{1,2}\.9{4}", "dmy"), (r"9{1,2}\.9{1,2}\.9{2}", "dmy"), ("9{1,2}-9{1,2}-9{4}", "dmy"),
    (r"9{1,2}[.]?[- ]a{3,9}\.?[- ]9{4}", "dmy"), (r"9{1,2}[.]?[- ]a{3,9}\.?[- ]9{2}", "dmy"), (r"a{3,9}\.? 9{1,2},? 9{4}", "mdy"), ("9{8}", "ymd8"),
]
_TIME = r"(?:(?P<hms>9{1,2}:9{2}(?::9{2}(?:[.,]9{1,9})?)?)|(?P<six>9{6}(?:[.,]9{1,9})?))"
_ZONE = r"(?: ?(?P<half>aa|a\.a\.)(?= |$))?(?: ?(?P<zone>a{1,5}|[+-]9{2}:?9{2}|[+-]9{2}))?"


@dataclass(frozen=True)
class Parser:
    """Places of the parts in every text of a mask."""

    epoch_digits: int = 0
    ymd: tuple[tuple[int, int], ...] = ()
    order: str = ""
    hms: tuple[tuple[int, int], ...] = ()
    fraction: tuple[int, int] | None = None
    half: tuple[int, int] | None = None
    zone: tuple[int, int] | None = None


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> Parser | None:
    """The parser of a mask; None if no text of this shape is a date, a time or both."""
    if mask in ("9" * 10, "9" * 13):
        return Parser(epoch_digits=len(mask))
    for shape_, order in [*_DATE, ("", "")]:
        m = re.fullmatch(rf"(?P<date>{shape_})" + (rf"(?:(?:[T ]|a| a )?{_TIME}{_ZONE})?" if shape_ else f"{_TIME}{_ZONE}"), mask)
        if not m or (m["hms"] is None and m["six"] is None and not shape_):
            continue
        ymd: tuple = ()
        if order == "ymd8":
            ymd, order_ = ((0, 4), (4, 6), (6, 8)), "ymd"
        elif shape_:
            ymd, order_ = tuple(x.span() for x in re.finditer("9+|a+", m["date"])), order
        else:
            order_ = ""
        hms: tuple = ()
        fraction = None
        if (name := "hms" if m["hms"] else "six" if m["six"] else None) is not None:
            whole = re.split("[.,]", m[name])[0]
            at = m.start(name)
            hms = tuple((at + x.start(), at + x.end()) for x in re.finditer("9+" if name == "hms" else "99", whole))
            if len(whole) < len(m[name]):
                fraction = (at + len(whole) + 1, m.end(name))
        half = m.span("half") if m["half"] else None
        zone = m.span("zone") if m["zone"] else None
        if half is None and zone is not None and m["zone"] == "aa":
            half, zone = zone, None
        return Parser(ymd=ymd, order=order_, hms=hms, fraction=fraction, half=half, zone=zone)
    return None


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    v = np.zeros(len(chars), dtype=np.int64)
    for i in range(*span):
        v = v * 10 + (chars[:, i].astype(np.int64) - 48)
    return v


def _words(texts: np.ndarray, span: tuple[int, int], meaning) -> np.ndarray:  # noqa: ANN001
    """What the distinct words at a place mean, NaN where nothing."""
    parts = np.array([t[span[0] : span[1]] for t in texts], dtype=object)
    known = {p: meaning(p) for p in set(parts)}
    return np.array([np.nan if known[p] is None else known[p] for p in parts], dtype=float)


@dataclass
class Parsed:
    """What texts state: day as ms since 1970, time of day in ms, zone in minutes; NONE where not stated; ok: all that is stated is real."""

    ok: np.ndarray
    epoch: np.ndarray
    day: np.ndarray
    tod: np.ndarray
    zone: np.ndarray


def parse(texts: pd.Series, orders: pd.Series) -> Parsed:
    n = len(texts)
    text = texts.fillna("").str.strip().to_numpy(dtype=object)
    order = orders.to_numpy(dtype=object)
    out = Parsed(np.zeros(n, bool), *(np.full(n, NONE) for _ in range(4)))
    masks = pd.Series(text).str.replace(r"\d", "9", regex=True).str.replace(r"[^\W\d_]", "a", regex=True)
    for mask, at in masks.groupby(masks, sort=False).indices.items():
        p = parser_of(mask)
        if p is None:
            continue
        own = text[at]
        chars = np.array(own, dtype=f"<U{len(mask)}").view(np.uint32).reshape(len(own), len(mask))
        ok = np.ones(len(own), bool)
        for i, c in enumerate(mask):
            if c == "9":  # other digits than 0 to 9 are not read
                ok &= (chars[:, i] >= 48) & (chars[:, i] <= 57)
        chars = np.where(ok[:, None], chars, 48)
        if p.epoch_digits:
            out.epoch[at] = np.where(ok, _digits(chars, (0, p.epoch_digits)) * (1000 if p.epoch_digits == 10 else 1), NONE)
            out.ok[at] = ok
            continue
        if p.ymd:
            parts = [_digits(chars, s) if mask[s[0]] == "9" else _words(own, s, lambda w: MONTHS.get(w.lower()[:3])) for s in p.ymd]
            how = np.array([p.order] * len(own), dtype=object) if p.order != "?" else order[at]
            y, m, d = (np.full(len(own), np.nan) for _ in range(3))
            for o in ("ymd", "dmy", "mdy"):
                is_o = how == o
                for k, v in zip(o, parts, strict=True):
                    t = {"y": y, "m": m, "d": d}[k]
                    t[is_o] = v[is_o]
            if p.order == "?" and len(mask) and p.ymd[2][1] - p.ymd[2][0] == 4:  # the year's place is plain: the order holds for day and month
                y = parts[2].astype(float)
                d, m = np.where(how == "mdy", parts[1], parts[0]).astype(float), np.where(how == "mdy", parts[0], parts[1]).astype(float)
                d = np.where(np.isin(how, ("dmy", "mdy")), d, np.nan)
            width = [s[1] - s[0] for s in p.ymd]
            y = np.where((y < 100) & (min(width) <= 2) & (4 not in width), y + 2000, y)
            real = ok & ~np.isnan(y) & ~np.isnan(m) & ~np.isnan(d)
            y, m, d = (np.where(real, v, 1).astype(np.int64) for v in (y, m, d))
            real &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
            month = (np.where(real, y, 1970) - 1970) * 12 + np.where(real, m, 1) - 1
            first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
            length = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
            real &= d <= length
            out.day[at] = np.where(real, (first + d - 1) * DAY_MS, NONE)
            ok &= real
        if p.hms:
            h, mi, s = [*(_digits(chars, x) for x in p.hms), np.zeros(len(own), np.int64)][:3]
            if p.half:
                half = _words(own, p.half, lambda w: {"am": 0, "pm": 12}.get(w.lower().replace(".", "")))
                ok &= ~np.isnan(half) & (h >= 1) & (h <= 12)
                h = h % 12 + np.nan_to_num(half).astype(np.int64)
            ms = np.zeros(len(own), np.int64)
            if p.fraction:
                a, b = p.fraction
                b = min(b, a + 3)
                ms = _digits(chars, (a, b)) * 10 ** (3 - (b - a))
            ok &= (h < 24) & (mi < 60) & (s < 60)
            out.tod[at] = np.where(ok, ((h * 60 + mi) * 60 + s) * 1000 + ms, NONE)
        if p.zone:
            a, b = p.zone
            if mask[a] in "+-":
                minutes = _digits(chars, (a + 1, a + 3)) * 60 + (_digits(chars, (b - 2, b)) if b - a > 3 else 0)
                sign = np.where(chars[:, a] == ord("-"), -1, 1)
                ok &= minutes <= 18 * 60
                out.zone[at] = np.where(ok, sign * minutes, NONE)
            else:
                z = _words(own, p.zone, lambda w: ABBREVIATIONS.get(w.upper()))
                ok &= ~np.isnan(z)
                out.zone[at] = np.where(ok, np.nan_to_num(z).astype(np.int64), NONE)
        out.ok[at] = ok
    return out


def resolve(date: pd.Series, time: pd.Series, order: pd.Series, zone: pd.Series, tables: dict[str, ZoneTable]) -> tuple[np.ndarray, np.ndarray]:
    """Earlier and later UTC instant (ms) that a date and a time state; NONE where they state none. ``tables`` by zone name."""
    d, t = parse(date, order), parse(time, order)
    n = len(date)
    lo, hi = np.full(n, NONE), np.full(n, NONE)
    local = np.where(d.ok & t.ok & (d.day != NONE) & (t.tod != NONE), d.day + t.tod, NONE)
    stated = (local != NONE) & (t.zone != NONE)
    lo[stated] = local[stated] - t.zone[stated] * 60_000
    zones = zone.to_numpy(dtype=object)
    for name, table in tables.items():
        own = (local != NONE) & ~stated & (zones == name)
        if own.any():
            lo[own], hi[own] = to_utc(local[own], table)
    unix = t.ok & (t.epoch != NONE)
    lo[unix] = t.epoch[unix]
    hi = np.where(hi == NONE, lo, hi)
    return lo, hi


def day_of(date: pd.Series, order: pd.Series) -> np.ndarray:
    """Days since 1970 that texts state: as written, or in UTC if a time with a zone or a Unix time is written; NONE if none."""
    p = parse(date, order)
    day = np.where(p.ok & (p.day != NONE), p.day, NONE)
    shifted = (day != NONE) & (p.tod != NONE) & (p.zone != NONE)
    day = np.where(shifted, day + p.tod - p.zone * 60_000, day)
    day = np.where(p.ok & (p.epoch != NONE), p.epoch, day)
    return np.where(day == NONE, NONE, day // DAY_MS)


def iso_ms(ms: np.ndarray) -> np.ndarray:
    return np.char.add(ms.astype("datetime64[ms]").astype(str), "Z")


def instants_utc(df: DataFrame, *, keys: list[str], file: str, run_ms: str, date: str, time: str, order: str, zone: str, zones: list[str]) -> DataFrame:
    """(keys, utc_ms, zone_version): the one UTC instant of each row whose date and time are real, and the version of the zone tables.

    zones: the zone names that may occur (a fixed, small list; rows of other zones without a stated zone give null).
    """
    tables = {z: t for z in zones if z and (t := zone_table(z)) is not None}
    cols = list(dict.fromkeys([*keys, file, run_ms]))
    src = df.select(*cols, F.col(date).alias("_d"), F.col(time).alias("_t"), F.col(order).alias("_o"), F.col(zone).alias("_z"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lo, hi = resolve(b._d, b._t, b._o, b._z, tables)
            ok = lo != NONE
            yield b[cols].assign(utc_lo=lo, utc_hi=hi)[ok]

    kinds = dict(df.dtypes)
    both = src.mapInPandas(work, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", utc_lo bigint, utc_hi bigint")
    return settle(both, file, run_ms).select(*keys, "utc_ms", F.lit(zone_version()).alias("zone_version"))


def settle(both: DataFrame, file: str, run_ms: str) -> DataFrame:
    """Choose between the two instants of a local time that occurs twice.

    The instants of a file differ as its ``run_ms`` do. The file's start is the median over its plain instants; where
    all occur twice, the latest start that any of them allows by its earlier reading: a clock that was put back
    shows an earlier start from then on.
    """
    both = cut(both)
    twice = F.col("utc_lo") != F.col("utc_hi")
    start = F.col("utc_lo") - F.col(run_ms)
    base = both.groupBy(file).agg(F.percentile_approx(F.when(~twice, start), 0.5, 1000).alias("_b"), F.max(F.when(twice, start)).alias("_m")).filter("_m is not null").select(file, F.coalesce("_b", "_m").alias("_b"))
    late = F.abs(F.col("utc_hi") - F.col(run_ms) - F.col("_b")) < F.abs(start - F.col("_b"))
    chosen = both.filter(twice).join(base, file).withColumn("utc_ms", F.when(late, F.col("utc_hi")).otherwise(F.col("utc_lo"))).drop("_b")
    return both.filter(~twice).withColumn("utc_ms", F.col("utc_lo")).unionByName(chosen)
