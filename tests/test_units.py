import pytest
from tidemark.operators.units import common_units, readings
from tidemark.sources.overlay import instants

B = "\\N"


def events(keys, values, file="f", start=0):
    return [(file, 1, start, "{\\an7}" + B.join(k + ":" for k in keys)), (file, 2, start, "{\\an7}" + B.join(values))]


def run(spark, rows, usual=(("f", "m", "cm", "deg", "C"),)):
    e = spark.createDataFrame(rows, "file string, event_no int, start_ms bigint, text string")
    u = spark.createDataFrame(list(usual), "file string, length string, range string, angle string, temperature string")
    return {(r.file, r.start_ms, r.name): (r.unit, round(r.common, 6)) for r in common_units(readings(instants(e), u)).collect()}


@pytest.mark.parametrize(
    ("key", "value", "unit", "want"),
    [
        ("Depth", "5.71 ftm", "fm", 10.442448), ("Depth, ft", "10", "ft", 3.048), ("Depth, ft", "10 m", "m", 10), ("Depth", "366cm", "cm", 3.66), ("Rangefinder", "87", "cm", 0.87), ('Rangefinder, "', "100", "in", 2.54),
        ("Rangefinder, '", "10", "ft", 3.048), ("Water Temp (Fahrenheit)", "50", "F", 10), ("Water Temp in °C", "1,5", "C", 1.5), ("Water Temp", "2.9479e2 K", "K", 21.64), ("Heading [gradians]", "400", "gon", 360), ("Heading", "3141.592654mrad", "mrad", 180),
        ("Pitch", "-1.5", "deg", -1.5), ("Camera Tilt in RAD", "+0,5", "rad", 28.64789), ("Roll", "−2 °", "deg", -2), ("Depth in yards", "010.0", "yd", 9.144), ("Depth", "+9.0 FT.", "ft", 2.7432),
    ],
)
def test_conversions(spark, key, value, unit, want):
    (got,) = run(spark, events([key], [value])).values()
    assert got == (unit, pytest.approx(want, abs=1e-6))


def test_unusable_readings(spark):
    got = run(spark, events(["Depth", "Pitch", "Roll", "Heading", "Water Temp", "Battery"], ["---", "ERR", "n/a", "", "5 m", "70 %"]))
    assert got == {}


def test_jumps_decide_where_nothing_is_declared(spark):
    rows = []
    for k in range(40):
        rows += events(["Depth"], [f"{5 + 0.01 * k:.2f} m" if k < 3 else f"{500 + k:.0f}" if 10 <= k < 25 else f"{5 + 0.01 * k:.2f}"], start=1000 * k)
    got = run(spark, rows, usual=[("other", "m", "m", "deg", "C")])
    units = [got["f", 1000 * k, "Depth"][0] for k in range(40)]
    assert units == ["m"] * 10 + ["cm"] * 15 + ["m"] * 15


def test_declared_units_win_over_jumps(spark):
    rows = events(["Depth"], ["5"]) + events(["Depth"], ["500"], start=10) + events(["Depth"], ["5 cm"], start=20)
    got = run(spark, rows)
    assert [got["f", t, "Depth"] for t in (0, 10, 20)] == [("m", 5), ("m", 500), ("cm", 0.05)]


def test_dirt(spark):
    rows = events(["Depth", "Depth"], ["5"]) * 2 + [("f", None, 0, "x"), (None, 1, 0, "{}Depth:"), ("f", 3, 0, None), ("f", 9, 7, "{a}Depth:"), ("f", 1, 8, "no style"), ("f", 2, 8, "")]
    assert run(spark, rows) == {("f", 0, "Depth"): ("m", 5)}
    e = spark.createDataFrame([], "file string, event_no int, start_ms bigint, text string")
    assert instants(e).count() == 0


@pytest.mark.parametrize("block_ms", [3_600_000, 20_000])
def test_a_unit_stated_once_holds_over_blocks(spark, block_ms):
    """Also backwards: before it is stated, the chain knows it from what comes after."""
    rows = []
    for k in range(100):
        feet = k >= 60
        rows += events(["Depth"], [f"{500 + k} mm" if k == 30 else f"{500 + k}" if not feet else f"{(500 + k) / 304.8:.3f}"], start=1000 * k)
    e = spark.createDataFrame(rows, "file string, event_no int, start_ms bigint, text string")
    u = spark.createDataFrame([("g", "m", "m", "deg", "C")], "file string, length string, range string, angle string, temperature string")
    got = {r.start_ms // 1000: r.unit for r in common_units(readings(instants(e), u), block_ms=block_ms).collect()}
    assert [got[k] for k in range(100)] == ["mm"] * 60 + ["ft"] * 40
