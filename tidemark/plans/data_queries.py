"""Queries of the general data problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.regular_grid import regular_grid
from tidemark.operators.spikes import implausible
from tidemark.operators.timestamps import NONE, day_of, instants_utc, iso_ms
from tidemark.operators.units import COMMON, UNITS, common_units, readings
from tidemark.runtime import table
from tidemark.sources.overlay import instants, reading

#: recorders is a fixed table; more rows than this are refused rather than collected.
MOST_RECORDERS = 10_000


def implausible_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(table(spark, sf_dir, "frames"), id="frame_id", source="inspection_id", order="framenumber")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(spark, sf_dir).select(F.col("id").alias("frame_id"), "field").distinct()


def p2_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that are impossible or stuck, whatever their neighbours' course."""
    return implausible_readings(spark, sf_dir).filter("impossible or stuck").select(F.col("id").alias("frame_id"), "field", "impossible", "stuck").distinct()


def file_recorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file: its recorder's columns."""
    files = table(spark, sf_dir, "inspections").filter("file is not null").groupBy("file").agg(F.min("recorder").alias("recorder"))
    return files.join(table(spark, sf_dir, "recorders"), "recorder", "left")


def p3_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, start_ms, utc_ms) of the overlay's usable instants."""
    zones = [r[0] for r in table(spark, sf_dir, "recorders").select("clock_zone").distinct().limit(MOST_RECORDERS + 1).collect()]
    if len(zones) > MOST_RECORDERS:
        raise ValueError("recorders is not the small fixed table that this plan expects")
    at = instants(table(spark, sf_dir, "telemetry_raw")).select("file", "start_ms", reading(F.col("readings"), "Date").alias("date"), reading(F.col("readings"), "Time").alias("time")).filter("time is not null")
    joined = at.join(file_recorders(spark, sf_dir).select("file", "field_order", "clock_zone"), "file", "left")
    return instants_utc(joined, keys=["file", "start_ms"], file="file", run_ms="start_ms", date="date", time="time", order="field_order", zone="clock_zone", zones=zones)


def p3_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inspection_id, normal) of the usable inspection dates."""
    rows = table(spark, sf_dir, "inspections").select("inspection_id", "date", "recorder").filter("inspection_id is not null and date is not null").distinct().join(table(spark, sf_dir, "recorders").select("recorder", "field_order"), "recorder", "left")

    def work(batches):  # noqa: ANN001, ANN202
        for b in batches:
            day = day_of(b.date, b.field_order)
            ok = day != NONE
            yield b[["inspection_id"]][ok].assign(normal=day[ok].astype("datetime64[D]").astype(str))

    return rows.select("inspection_id", "date", "field_order").mapInPandas(work, "inspection_id int, normal string").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield b[["record_key"]].assign(normal=iso_ms(b.utc_ms.to_numpy()))

    times = p3_instants(spark, sf_dir).select(F.concat_ws("#", "file", F.col("start_ms").cast("string")).alias("record_key"), "utc_ms").mapInPandas(text, "record_key string, normal string")
    days = p3_days(spark, sf_dir).select(F.col("inspection_id").cast("string").alias("record_key"), "normal")
    return times.select(F.lit("telemetry_raw").alias("source"), "record_key", "normal").unionByName(days.select(F.lit("inspections").alias("source"), "record_key", "normal"))


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(table(spark, sf_dir, "telemetry"), source="inspection_id", time="time")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_grid(spark, sf_dir).filter("missing").select(F.col("source").alias("inspection_id"), "field", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"))


def p5_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inspection_id, field, slots, missing, filled, off): of each series all slots, the missing, those that have a value, and those whose value lies far from the mean of the slot's own readings."""
    g = p5_grid(spark, sf_dir)
    t = table(spark, sf_dir, "telemetry").filter("inspection_id is not null and time is not null").select("inspection_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', time) div 10").alias("k"), F.expr("stack(2, 'depth', depth, 'pitch', pitch) as (field, v)"))
    own = t.filter("v is not null and not isnan(v)").groupBy(F.col("inspection_id").alias("source"), "field", "k").agg(F.avg("v").alias("own"))
    g = g.withColumn("k", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', slot) div 10")).join(own, ["source", "field", "k"], "left")
    off = F.abs(F.col("value") - F.col("own")) > 10 + 6 * F.col("sd")
    return g.groupBy(F.col("source").alias("inspection_id"), "field").agg(F.count(F.lit(1)).alias("slots"), F.count_if("missing").alias("missing"), F.count("value").alias("filled"), F.count_if(off).alias("off"))


def p6_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    usual = file_recorders(spark, sf_dir).select("file", F.col("depth_unit").alias("length"), F.col("range_unit").alias("range"), F.col("angle_unit").alias("angle"), F.col("temp_unit").alias("temperature"))
    return common_units(readings(instants(table(spark, sf_dir, "telemetry_raw")), usual))


def p6_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, start_ms, name, value, unit, common): all readings decoded without what recorders usually measure in, so that of most only the chain can tell."""
    none = F.lit(None).cast("string")
    files = table(spark, sf_dir, "telemetry_raw").select("file").distinct().select("file", *[none.alias(c) for c in ("length", "range", "angle", "temperature")])
    return common_units(readings(instants(table(spark, sf_dir, "telemetry_raw")), files)).filter("not declared").select("file", "start_ms", "name", "value", "unit", "common")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p6_common(spark, sf_dir).filter(~F.col("unit").isin(*COMMON.values()))
    return rows.select("file", "start_ms", "name", F.rint(F.col("common") * 1000).cast("long").alias("milli")).distinct()


def p6_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is declared, in common units."""
    return p6_common(spark, sf_dir).filter("declared").select("file", "start_ms", "name", "value", "unit", F.round("common", 6).alias("common"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_readings": implausible_readings, "p2_certain": p2_certain, "p3_found": p3_found, "p5_found": p5_found, "p5_grid": p5_grid, "p5_slots": p5_slots, "p6_found": p6_found, "p6_common": p6_common, "p6_declared": p6_declared, "p6_undeclared": p6_undeclared}


_UNITS = ", ".join(f"('{q}', '{n.replace(chr(39), chr(39) * 2)}', '{u}', {factor!r}::DOUBLE, {offset!r}::DOUBLE)" for u, (q, factor, offset, names) in UNITS.items() for n in names)


_READINGS = """f AS (SELECT DISTINCT frame_id, inspection_id AS i, framenumber AS o, depth, heading, roll, rangefinder FROM frames WHERE frame_id IS NOT NULL),
r AS (SELECT frame_id, i, o, unnest(['depth', 'heading', 'roll', 'rangefinder']) AS field, unnest([depth, heading, roll, rangefinder]) AS v FROM f), v AS (SELECT *, v < CASE field WHEN 'roll' THEN -180 ELSE 0 END OR v > CASE field WHEN 'depth' THEN 300 WHEN 'heading' THEN 360 WHEN 'roll' THEN 180 ELSE 100 END OR (field = 'heading' AND v >= 360) AS impossible FROM r WHERE v IS NOT NULL AND NOT isnan(v)),
p AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY i, field ORDER BY o, frame_id) THEN 1 ELSE 0 END AS x FROM v WHERE i IS NOT NULL AND o IS NOT NULL AND NOT isnan(o)), g AS (SELECT *, sum(x) OVER (PARTITION BY i, field ORDER BY o, frame_id ROWS UNBOUNDED PRECEDING) AS k FROM p),
s AS (SELECT *, count(*) OVER (PARTITION BY i, field, k) >= 6 AS stuck FROM g)"""


def _wrap(x: str) -> str:
    """SQL of an angle's difference within half a turn, of others as it is."""
    return f"CASE WHEN field = 'heading' THEN ({x}) - 360 * floor(({x}) / 360 + 0.5) ELSE {x} END"


def _height(width: int) -> str:
    """SQL of the height of the stretch of ``width`` readings that begins here."""
    after = f"a{width}"
    middle = f"(b + ({_wrap(f'{after} - b')}) / 2)"
    detail, back, front = ([f"({_wrap(f'u{j} - {of}')})" for j in range(width)] for of in (middle, "b", after))
    same = " AND ".join(f"sign({x}) = sign({detail[0]})" for x in [*detail, *back, *front])
    low = f"least({', '.join(f'abs({x})' for x in detail)})" if width > 1 else f"abs({detail[0]})"
    rise = f"least({', '.join(f'abs({x})' for x in [*back, *front])})"
    known = " AND ".join(f"u{j} IS NOT NULL" for j in range(width)) + f" AND b IS NOT NULL AND {after} IS NOT NULL"
    return f"CASE WHEN {known} AND {same} AND {rise} >= 0.5 * {low} THEN {low} ELSE 0 END"


_DECLARED = f"""WITH u(q, n, u, f, o) AS (VALUES {_UNITS}), rec AS (SELECT file, min(recorder) AS recorder FROM inspections WHERE file IS NOT NULL GROUP BY 1),
e AS (SELECT file, start_ms, row_number() OVER (PARTITION BY file, start_ms ORDER BY event_no) AS n, string_split(regexp_replace(text, '^[^}}]*\\}}', ''), '\\N') AS l FROM (SELECT DISTINCT * FROM telemetry_raw)),
p AS (SELECT k.file, k.start_ms, unnest(k.l) AS k, unnest(v.l[:len(k.l)]) AS v FROM e k JOIN e v ON k.file = v.file AND k.start_ms = v.start_ms AND k.n % 2 = 1 AND v.n = k.n + 1),
r AS (SELECT file, start_ms, regexp_extract(k, '^(Depth|Rangefinder|Water Temp|Heading|Pitch|Roll|Camera Tilt)', 1) AS name, regexp_replace(regexp_extract(k, '^(?:Depth|Rangefinder|Water Temp|Heading|Pitch|Roll|Camera Tilt)(?:, | in | \\(| \\[)?(.*):$', 1), '[\\])]$', '') AS ku,
regexp_extract(v, '^([+-]?[0-9]+(?:[.,][0-9]+)?(?:e-?[0-9]+)?)\\s*(.*)$', 1) AS x, regexp_extract(v, '^([+-]?[0-9]+(?:[.,][0-9]+)?(?:e-?[0-9]+)?)\\s*(.*)$', 2) AS vu FROM p),
s AS (SELECT r.*, CASE WHEN name IN ('Depth', 'Rangefinder') THEN 'length' WHEN name = 'Water Temp' THEN 'temperature' ELSE 'angle' END AS q, CASE name WHEN 'Depth' THEN depth_unit WHEN 'Rangefinder' THEN range_unit WHEN 'Water Temp' THEN temp_unit ELSE angle_unit END AS du FROM r LEFT JOIN rec USING (file) LEFT JOIN recorders USING (recorder) WHERE name <> '' AND x <> '')"""


def oracle_sql() -> dict[str, str]:
    """None for p3, whose notations are no plain SQL; see the tests."""
    return {
        "p2_certain": f"""WITH {_READINGS} SELECT DISTINCT frame_id, field, impossible, coalesce(stuck, false) AS stuck FROM v LEFT JOIN (SELECT frame_id, i, o, field, stuck FROM s) s USING (frame_id, i, o, field) WHERE impossible OR stuck""",
        # the same details by windows over the whole series
        "p2_found": f"""WITH {_READINGS}, y AS (SELECT frame_id, i, field, v, row_number() OVER w AS n, v - lag(v) OVER w AS d FROM p WHERE NOT impossible WINDOW w AS (PARTITION BY i, field ORDER BY o, frame_id)),
t AS (SELECT *, {_wrap('d')} AS step FROM y), u AS (SELECT *, CASE WHEN field = 'heading' THEN first_value(v) OVER w + coalesce(sum(step) OVER w, 0) ELSE v END AS u0 FROM t WINDOW w AS (PARTITION BY i, field ORDER BY n ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, lead(u0, 1) OVER q AS u1, lead(u0, 2) OVER q AS u2, median(u0) OVER (PARTITION BY i, field ORDER BY n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, {', '.join(f'median(u0) OVER (PARTITION BY i, field ORDER BY n ROWS BETWEEN {w} FOLLOWING AND {w + 2} FOLLOWING) AS a{w}' for w in (1, 2, 3))} FROM u WINDOW q AS (PARTITION BY i, field ORDER BY n)),
h AS (SELECT *, {', '.join(f'{_height(w)} AS h{w}' for w in (1, 2, 3))} FROM m), e AS (SELECT *, greatest(h1, h2, lag(h2, 1, 0) OVER q, h3, lag(h3, 1, 0) OVER q, lag(h3, 2, 0) OVER q) AS height FROM h WINDOW q AS (PARTITION BY i, field ORDER BY n)),
c AS (SELECT i, field, quantile_disc(abs(step), 0.5) * (1.482602218505602 / sqrt(2)) AS scatter FROM t WHERE step IS NOT NULL GROUP BY 1, 2)
SELECT frame_id, field FROM v WHERE impossible UNION SELECT frame_id, field FROM s WHERE stuck UNION SELECT frame_id, field FROM e JOIN c USING (i, field) WHERE scatter > 0 AND height / scatter >= 8""",
        # by what is declared alone: with the value, in the key, by the recorder
        "p6_found": f"""{_DECLARED}
SELECT DISTINCT file, start_ms, name, CAST(round_even((replace(x, ',', '.')::DOUBLE + o) * f * 1000, 0) AS BIGINT) AS milli FROM s JOIN u ON u.q = s.q AND u.n = lower(CASE WHEN vu <> '' THEN vu WHEN ku <> '' THEN ku ELSE du END) WHERE u.u NOT IN ('m', 'deg', 'C')""",
        "p6_declared": f"""{_DECLARED}
SELECT DISTINCT file, start_ms, name, replace(x, ',', '.')::DOUBLE AS value, u.u AS unit, round((replace(x, ',', '.')::DOUBLE + o) * f, 6) AS common FROM s JOIN u ON u.q = s.q AND u.n = lower(CASE WHEN vu <> '' THEN vu WHEN ku <> '' THEN ku ELSE du END)""",
        "p5_slots": """WITH t AS (SELECT inspection_id AS i, epoch_us(time) // 10000000 AS s, depth, heading, pitch FROM telemetry WHERE inspection_id IS NOT NULL AND time IS NOT NULL),
g AS (SELECT i, max(s) - min(s) + 1 AS slots FROM t GROUP BY i), h AS (SELECT i, s, unnest(['depth', 'heading', 'pitch']) AS field, unnest([depth, heading, pitch]) AS v FROM t), n AS (SELECT i, field, count(DISTINCT s) AS full_ FROM h WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2),
f AS (SELECT i, slots, unnest(['depth', 'heading', 'pitch']) AS field FROM g) SELECT i AS inspection_id, field, slots, slots - coalesce(full_, 0) AS missing, CASE WHEN full_ > 0 THEN slots ELSE 0 END AS filled, 0 AS off FROM f LEFT JOIN n USING (i, field)""",
        "p5_found": """WITH t AS (SELECT inspection_id AS i, epoch_us(time) // 10000000 AS s, depth, heading, pitch FROM telemetry WHERE inspection_id IS NOT NULL AND time IS NOT NULL),
g AS (SELECT i, unnest(generate_series(min(s), max(s))) AS s FROM t GROUP BY i), f AS (SELECT i, s, unnest(['depth', 'heading', 'pitch']) AS field FROM g),
h AS (SELECT i, s, unnest(['depth', 'heading', 'pitch']) AS field, unnest([depth, heading, pitch]) AS v FROM t), full_ AS (SELECT DISTINCT i, s, field FROM h WHERE v IS NOT NULL AND NOT isnan(v))
SELECT i AS inspection_id, field, strftime(make_timestamp(s * 10000000), '%Y-%m-%d %H:%M:%S') AS slot FROM f ANTI JOIN full_ USING (i, s, field)""",
    }
