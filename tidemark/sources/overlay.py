"""Subtitle telemetry: timed text events in which key lists and value lists alternate.

``instants`` gives one row for each instant of each file, with its readings as an array of (key, value).
The work is split, zip and array functions of Spark alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The literal that separates the lines of a subtitle event.
LINE_BREAK = r"\\N"


def instants(events: DataFrame) -> DataFrame:
    """(file, start_ms, readings ARRAY<STRUCT<key, value>>).

    Events of one file and start form one instant; in the order of event_no they are key list, value list,
    key list and so on. Text up to and including the first ``}`` is style. Keys are stripped of space and a
    closing colon; where lists differ in length the shorter one holds; an odd last event has no partner and is
    dropped. Repeated events count once. Events with a null in any of the four columns are dropped.
    """
    e = events.select("file", "event_no", "start_ms", "text").na.drop()
    lines = F.split(F.regexp_replace("text", r"^[^}]*\}", ""), LINE_BREAK)
    grouped = e.groupBy("file", "start_ms").agg(F.sort_array(F.collect_set(F.struct("event_no", lines.alias("lines")))).alias("ev")).filter(F.size("ev") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.size("ev") - 2, F.lit(2)), lambda i: F.arrays_zip(F.col("ev")[i]["lines"].alias("key"), F.col("ev")[i + 1]["lines"].alias("value")))
    pairs = F.transform(F.flatten(pairs), lambda p: F.struct(F.regexp_replace(F.trim(p["key"]), r"\s*:\s*$", "").alias("key"), p["value"].alias("value")))
    return grouped.select("file", "start_ms", F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull()).alias("readings"))


def reading(readings: "F.Column", key: str) -> "F.Column":
    """The first value of a key, null where there is none."""
    return F.get(F.filter(readings, lambda r: r["key"] == key), F.lit(0))["value"]
