"""Quantities in different units to common ones.

Method. Each device's series of a quantity (one file, one name) is a hidden Markov chain whose state is the
unit of the reading. Evidence for the state: a unit written with the value or in its key fixes it; the
recorder's own unit is strong evidence (``trust``) for a reading that states none. Between successive readings
a switch of unit costs ``switch``, and the jump in log value that a unit implies is weighed against a smooth
underlying level by a heavy-tailed cost of at most ``cap``, so that a real change of level never outweighs what
is written. A unit that would give a value out of the quantity's usual range has a little against it in each reading, and other
than common units next to nothing. Viterbi decodes all series of a batch at once; where nothing is written and the recorder is not
known, the jumps decide. An exact conversion by the decoded unit follows.

Scale. Parsing is Spark expressions alone. A file is decoded in blocks of ``block_ms`` of its running time, so
no task holds a whole file. Where every reading has a declared unit the blocks are independent: what is declared outweighs any jump. Series
without a recorder's unit are decoded a second time, exactly as if in one piece, with what is usual for the quantity among all that is declared: each block is summed up by a matrix of the best
scores from each state before it to each state at its end, the matrices, one row a block, are multiplied through from both ends, and each block is decoded between
the scores that come to it from before and after. So a unit stated once holds for hours.

Defined results. Texts that are no number give no reading; a unit that is not known for the quantity makes the
reading unusable. Repeated readings of one instant count once. Null file, time or name give no reading.
Rounding to thousandths is half to even of the double product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import carried, cut, map_segments

# Units as (quantity, factor to the common unit, offset added before the factor, spellings in lower case).
UNITS = {
    "m": ("length", 1.0, 0.0, ["m", "meter", "meters", "metre", "metres", "mtr"]),
    "cm": ("length", 0.01, 0.0, ["cm", "centimetre", "centimetres", "centimeter", "centimeters"]),
    "mm": ("length", 0.001, 0.0, ["mm", "millimetre", "millimetres", "millimeter", "millimeters"]),
    "ft": ("length", 0.3048, 0.0, ["ft", "ft.", "feet", "foot", "'"]),
    "in": ("length", 0.0254, 0.0, ["in", "in.", "inch", "inches", '"']),
    "yd": ("length", 0.9144, 0.0, ["yd", "yd.", "yard", "yards"]),
    "fm": ("length", 1.8288, 0.0, ["fm", "ftm", "fath.", "fathom", "fathoms"]),
    "km": ("length", 1000.0, 0.0, ["km", "kilometre", "kilometres"]),
    "deg": ("angle", 1.0, 0.0, ["deg", "deg.", "degree", "degrees", "°"]),
    "rad": ("angle", 180.0 / np.pi, 0.0, ["rad", "radian", "radians"]),
    "mrad": ("angle", 0.18 / np.pi, 0.0, ["mrad", "milliradian", "milliradians"]),
    "gon": ("angle", 0.9, 0.0, ["gon", "grad", "grads", "gradian", "gradians"]),
    "C": ("temperature", 1.0, 0.0, ["c", "°c", "degc", "celsius"]),
    "F": ("temperature", 5.0 / 9.0, -32.0, ["f", "°f", "degf", "fahrenheit"]),
    "K": ("temperature", 1.0, -273.15, ["k", "kelvin", "°k"]),
}
COMMON = {"length": "m", "angle": "deg", "temperature": "C"}
# Ranges in the common unit outside of which a value speaks against the unit that gives it.
USUAL = {"length": (0.0, 300.0), "angle": (-180.0, 360.0), "temperature": (-3.0, 45.0)}
QUANTITY = {"Depth": "length", "Rangefinder": "length", "Water Temp": "temperature", "Heading": "angle", "Pitch": "angle", "Roll": "angle", "Camera Tilt": "angle"}

_NUMBER = r"^\s*([+\-−]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+\-]?\d+)?)\s*(.*?)\s*$"


def spelled(quantity: "F.Column", text: "F.Column") -> "F.Column":
    """Code of a unit from its spelling; '' for no text, '?' for one that isn't known for the quantity."""
    pairs = [(f"{q}|{s}", u) for u, (q, _, _, names) in UNITS.items() for s in names]
    known = F.create_map(*[F.lit(x) for p in pairs for x in p])
    t = F.lower(F.trim(text))
    return F.when(F.coalesce(t, F.lit("")) == "", "").otherwise(F.coalesce(F.try_element_at(known, F.concat(quantity, F.lit("|"), t)), F.lit("?")))


def readings(instants: DataFrame, defaults: DataFrame) -> DataFrame:
    """(file, start_ms, name, quantity, value, stated, usual) of the numeric readings of ``instants``.

    defaults: (file, length, range, angle, temperature): the recorder's units as texts.
    """
    names = "|".join(QUANTITY)
    quantity = F.create_map(*[F.lit(x) for p in QUANTITY.items() for x in p])
    flat = instants.select("file", "start_ms", F.explode("readings").alias("r")).select("file", "start_ms", F.regexp_extract("r.key", f"^({names})(?:\\s*[,(\\[]|\\s+in\\s|\\s*$)", 1).alias("name"), F.col("r.key").alias("key"), F.col("r.value").alias("text")).filter("name <> ''")
    in_key = F.regexp_extract(F.expr("substring(key, length(name) + 1)"), r"^\s*(?:,|\bin\b|[(\[])\s*(.*?)\s*[)\]]?\s*$", 1)
    flat = flat.withColumn("quantity", F.element_at(quantity, F.col("name"))).withColumn("number", F.regexp_extract("text", _NUMBER, 1)).filter("number <> ''")
    with_value = F.regexp_extract("text", _NUMBER, 2)
    flat = flat.select("file", "start_ms", "name", "quantity", F.expr("try_cast(replace(replace(number, ',', '.'), '−', '-') as double)").alias("value"), F.when(with_value != "", spelled(F.col("quantity"), with_value)).otherwise(spelled(F.col("quantity"), in_key)).alias("stated"))
    flat = flat.filter("value is not null and stated <> '?'").dropDuplicates(["file", "start_ms", "name", "value", "stated"])
    usual = F.expr("CASE WHEN name = 'Rangefinder' THEN `range` WHEN quantity = 'length' THEN `length` WHEN quantity = 'angle' THEN angle ELSE temperature END")
    return flat.join(defaults, "file", "left").select("file", "start_ms", "name", "quantity", "value", "stated", F.coalesce(spelled(F.col("quantity"), usual), F.lit("")).alias("usual"))


def viterbi(x: np.ndarray, real: np.ndarray, evidence: np.ndarray, factor: np.ndarray, offset: np.ndarray, switch: float, cap: float, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """Decoded state of each step: (series, steps). evidence: (series, steps, states) log likelihoods; begin and end are added to those of the first and last step."""
    n, m = x.shape
    level = _levels(x, factor, offset)
    best = evidence[:, 0] + (0 if begin is None else begin)
    back = np.zeros((n, m, len(factor)), dtype=np.int8)
    for t in range(1, m):
        score = best[:, :, None] + _moves(level[:, t - 1], level[:, t], switch, cap)
        arg = score.argmax(1)
        new = np.take_along_axis(score, arg[:, None, :], 1)[:, 0] + evidence[:, t]
        live = real[:, t]
        back[:, t] = np.where(live[:, None], arg, np.arange(len(factor)))
        best = np.where(live[:, None], new, best)
    state = np.empty((n, m), dtype=np.int64)
    state[:, m - 1] = (best + (0 if end is None else end)).argmax(1)
    for t in range(m - 1, 0, -1):
        state[:, t - 1] = np.take_along_axis(back[:, t], state[:, t, None], 1)[:, 0]
    return state


def _levels(x: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Log value in the common unit for each state. Small readings are kept apart from 0 on their own scale, so that no unit has smaller jumps."""
    return np.log(np.abs(x[..., None] + offset) + 0.05) + np.log(factor)


def _moves(before: np.ndarray, after: np.ndarray, switch: float, cap: float) -> np.ndarray:
    """Score of each step from state to state: (series, from, to)."""
    jump = np.minimum(4.0 * np.abs(after[:, None, :] - before[:, :, None]), cap)
    return -jump - switch * (1 - np.eye(before.shape[1]))


def _evidence(batch: pd.DataFrame, states: list[str], trust: float, odd: float = 4.0, usual: tuple[float, float] | None = None) -> np.ndarray:
    """(rows, states): what is written against each state, and that it gives a value such as the quantity hardly has. usual: mean and deviation of its log."""
    factor, offset = (np.array([UNITS[u][i] for u in states]) for i in (1, 2))
    value = (batch.value.to_numpy(float)[:, None] + offset) * factor
    lo, hi = USUAL[UNITS[states[0]][0]]
    code = {u: i for i, u in enumerate(states)}
    out = np.where((value < lo) | (value > hi), -odd, 0.0) - 0.01 * (np.array(states) != COMMON[UNITS[states[0]][0]])
    if usual is not None:
        out -= np.minimum(0.5 * ((np.log(np.abs(value) + 0.05) - usual[0]) / max(usual[1], 0.5)) ** 2, odd)
    for column, weight in (("stated", 10 * trust), ("usual", trust)):
        known = batch[column].map(code).fillna(-1).to_numpy().astype(int)
        out -= np.where((known >= 0)[:, None] & (known[:, None] != np.arange(len(states))), weight, 0.0)
    return out


def common_units(rows: DataFrame, *, switch: float = 3.0, cap: float = 12.0, trust: float = 1e4, block_ms: int = 3_600_000) -> DataFrame:
    """(file, start_ms, name, value, unit, declared, common): each reading with its decoded unit and its value in the common unit."""
    by_quantity = {q: [u for u, v in UNITS.items() if v[0] == q] for q in COMMON}
    src = rows.filter("file is not null and start_ms is not null and name is not null").withColumn("block", F.expr(f"start_ms div {block_ms}"))

    def work(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        unit = np.empty(len(batch), dtype=object)
        common = np.empty(len(batch))
        lengths = np.diff(np.r_[starts, len(batch)])
        quantity = batch.quantity.to_numpy()
        written = {q: _evidence(batch, states, trust) for q, states in by_quantity.items()}
        size_class = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)  # series of like length are decoded together
        for q, states in by_quantity.items():
            factor, offset = (np.array([UNITS[u][i] for u in states]) for i in (1, 2))
            for c in np.unique(size_class):
                mine = np.flatnonzero((quantity[starts] == q) & (size_class == c))
                if not len(mine):
                    continue
                cols = np.arange(lengths[mine].max())
                real = cols[None, :] < lengths[mine][:, None]
                pos = np.where(real, starts[mine][:, None] + cols, 0)
                ev = np.where(real[:, :, None], written[q][pos], 0.0)
                s = viterbi(batch.value.to_numpy(float)[pos], real, ev, factor, offset, switch, cap)
                at = pos[real]
                unit[at] = np.array(states, dtype=object)[s[real]]
                common[at] = (batch.value.to_numpy(float)[at] + offset[s[real]]) * factor[s[real]]
        return batch[["file", "start_ms", "name_", "value", "quantity", "stated", "usual", "block"]].assign(unit=unit, common=common)

    src = src.withColumnRenamed("name", "name_").select("file", "start_ms", "name_", "value", "quantity", "stated", "usual", "block")
    kinds = "file string, start_ms bigint, name_ string, value double, quantity string, stated string, usual string, block bigint, unit string, common double"
    decoded = cut(map_segments(src, ["file", "block", "name_"], ["start_ms", "value"], work, kinds))
    loose = decoded.filter("usual = ''")
    if not loose.isEmpty():
        log = F.log(F.abs("common") + 0.05)
        level = decoded.filter("stated <> '' or usual <> ''").groupBy("name_").agg(F.avg(log).alias("m"), F.stddev(log).alias("d")).filter("d is not null").collect()  # a row for each of the few names
        again = _chained(loose, {r.name_: (r.m, r.d) for r in level}, by_quantity, switch, cap, trust, kinds)
        decoded = decoded.filter("usual <> ''").select(*again.columns).unionByName(again)
    return decoded.select("file", "start_ms", F.col("name_").alias("name"), "value", "unit", F.expr("stated <> '' or usual <> ''").alias("declared"), "common")


def _chained(rows: DataFrame, usual: dict[str, tuple[float, float]], by_quantity: dict[str, list[str]], switch: float, cap: float, trust: float, kinds: str) -> DataFrame:
    """The rows with their units decoded over all blocks of their series."""
    d = rows.drop("unit", "common").withColumn("series", F.concat_ws("\x00", "file", "name_"))
    d = carried(d, "series", ["start_ms", "value"], F.col("block"), {"last": F.col("value")})  # the reading before this one
    units_of = {q: tuple(np.array([UNITS[u][i] for u in states]) for i in (1, 2)) for q, states in by_quantity.items()}

    def steps(batch: pd.DataFrame, s: int, e: int):  # noqa: ANN202
        """Scores of moving into each reading of a block, from the one before it, with its evidence: (steps, from, to)."""
        q = batch.quantity.iloc[s]
        x = np.r_[batch["last"].iloc[s], batch.value.iloc[s:e]].astype(float)
        level = _levels(x, *units_of[q])
        moves = _moves(np.nan_to_num(level[:-1]), level[1:], switch, cap)
        if np.isnan(x[0]):
            moves[0] = 0.0  # nothing comes before the first reading
        return moves + _evidence(batch.iloc[s:e], by_quantity[q], trust, usual=usual.get(batch.name_.iloc[s]))[:, None, :]

    def matrices(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            best = None
            for m in steps(batch, s, e):
                best = m if best is None else (best[:, :, None] + m[None]).max(1)
            out.append((batch.series.iloc[s], batch.block.iloc[s], best.tobytes()))
        return pd.DataFrame(out, columns=["series", "block", "m"])

    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        k = int(np.sqrt(len(pdf.m.iloc[0]) // 8))
        m = [np.frombuffer(x).reshape(k, k) for x in pdf.m]
        before, after = [np.zeros(k)], [np.zeros(k)]
        for x in m[:-1]:
            v = (before[-1][:, None] + x).max(0)
            before.append(v - v.max())
        for x in m[:0:-1]:
            v = (x + after[-1][None]).max(1)
            after.append(v - v.max())
        return pd.DataFrame({"series": pdf.series, "block": pdf.block, "before": [v.tobytes() for v in before], "after": [v.tobytes() for v in after[::-1]]})

    def decode(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        unit, common = np.empty(len(batch), dtype=object), np.empty(len(batch))
        for s, e in zip(starts, np.r_[starts[1:], len(batch)], strict=True):
            q = batch.quantity.iloc[s]
            best, back = np.frombuffer(batch.before.iloc[s]), []
            for m in steps(batch, s, e):
                score = best[:, None] + m
                back.append(score.argmax(0))
                best = score.max(0)
            state = np.empty(e - s, np.int64)
            state[-1] = (best + np.frombuffer(batch.after.iloc[s])).argmax()
            for t in range(e - s - 1, 0, -1):
                state[t - 1] = back[t][state[t]]
            factor, offset = units_of[q]
            unit[s:e] = np.array(by_quantity[q], dtype=object)[state]
            common[s:e] = (batch.value.iloc[s:e].to_numpy(float) + offset[state]) * factor[state]
        return batch[["file", "start_ms", "name_", "value", "quantity", "stated", "usual", "block"]].assign(unit=unit, common=common)

    sums = map_segments(d, ["series", "block"], ["start_ms", "value"], matrices, "series string, block bigint, m binary")
    known = sums.groupBy("series").applyInPandas(scores, "series string, block bigint, before binary, after binary")  # one row a block
    return map_segments(d.join(known, ["series", "block"]), ["series", "block"], ["start_ms", "value"], decode, kinds)
