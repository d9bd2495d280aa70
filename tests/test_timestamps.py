from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.operators.timestamps import NONE, day_of, instants_utc, iso_ms, parse, parser_of, resolve, shape, to_utc, zone_table


def utc(date, time, order="dmy", zone="UTC"):
    s = lambda v: pd.Series([v], dtype=object)
    lo, hi = resolve(s(date), s(time), s(order), s(zone), {zone: zone_table(zone)})
    return None if lo[0] == NONE else tuple(iso_ms(np.unique([lo[0], hi[0]])))


@pytest.mark.parametrize(
    ("date", "time", "order", "zone", "want"),
    [
        ("10/05/2022", "01:18:14", "dmy", "Europe/Oslo", "2022-05-09T23:18:14.000Z"), ("03/12/2017", "01:57:06 AM", "mdy", "UTC", "2017-03-12T01:57:06.000Z"),
        ("03/12/2017", "12:00:00 PM", "dmy", "UTC", "2017-12-03T12:00:00.000Z"), ("03/12/2017", "12:00:00 AM", "dmy", "UTC", "2017-12-03T00:00:00.000Z"),
        ("2019-09-18", "20:24:02 GMT", "ymd", "Europe/Oslo", "2019-09-18T20:24:02.000Z"), ("17.09.18", "13:45:52+0300", "dmy", "UTC", "2018-09-17T10:45:52.000Z"),
        ("20200420", "232619", "dmy", "UTC", "2020-04-20T23:26:19.000Z"), ("05-Oct-18", "11:11:16.625999", "dmy", "UTC", "2018-10-05T11:11:16.625Z"),
        ("2 Dec 2017", "12:53:33,7", "dmy", "UTC", "2017-12-02T12:53:33.700Z"), ("-", "1642022829", "dmy", "UTC", "2022-01-12T21:27:09.000Z"),
        (None, "1654759689091", "dmy", "UTC", "2022-06-09T07:28:09.091Z"), ("2023/04/24", "01:00:00 IST", "ymd", "UTC", "2023-04-23T19:30:00.000Z"),
        ("2023-04-24", "05:00:00 CEST", "ymd", "America/New_York", "2023-04-24T03:00:00.000Z"), ("2019-05-01", "09:54:30 PM", "dmy", "Australia/Sydney", "2019-05-01T11:54:30.000Z"),
    ],
)
def test_notations(date, time, order, zone, want):
    assert utc(date, time, order, zone) == (want,)


@pytest.mark.parametrize(
    ("date", "time"),
    [("31.02.2021", "10:00:00"), ("00.00.0000", "10:00:00"), ("25/25/2020", "10:00:00"), ("2020-01-01", "24:00:00"), ("2020-01-01", "--:--:--"), ("n/a", "10:00:00"), ("2020-01-01", None), (None, None), ("", ""), ("2020-01-01", "13:00:00 PM"), ("2020-01-01", "10:00:00 QQQ"), ("٢٠٢٠-01-01", "10:00:00"), ("2021-03-28", "02:30:00")],
)
def test_what_is_not_real(date, time):
    assert utc(date, time, "dmy", "Europe/Oslo") is None


def test_clock_put_back_gives_both():
    assert utc("2021-10-31", "02:30:00", "ymd", "Europe/Oslo") == ("2021-10-31T00:30:00.000Z", "2021-10-31T01:30:00.000Z")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 4_000_000_000), st.sampled_from(["Europe/Oslo", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC"]))
def test_tables_against_the_zone_database(second, zone):
    local = datetime.fromtimestamp(second, timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    ms = np.array([int((local - datetime(1970, 1, 1)).total_seconds()) * 1000])
    lo, hi = to_utc(ms, zone_table(zone))
    assert second * 1000 in (lo[0], hi[0])


def test_days():
    d = lambda v, o="dmy": None if (x := day_of(pd.Series([v], dtype=object), pd.Series([o], dtype=object))[0]) == NONE else str(x.astype("datetime64[D]"))
    assert d(" 2018-10-05 ") == "2018-10-05" and d("2. October 2018") == "2018-10-02" and d("Oct 19, 2018") == "2018-10-19"
    assert d("2020-04-20T04:53:08+10:00") == "2020-04-19" and d("2016-06-22 23:56 UTC") == "2016-06-22" and d("1655353481") == "2022-06-16"
    assert d("11/18/2017", "mdy") == "2017-11-18" and d("11/18/2017", "dmy") is None and d("11/18/2017", None) is None
    assert d("31.02.2021") is None and d("unknown") is None and d("") is None and d(None) is None and d("29.02.2020") == "2020-02-29"


def test_masks_are_parsed_once():
    parser_of.cache_clear()
    parse(pd.Series(["2018-10-05", "2019-11-06", "x"] * 100), pd.Series(["dmy"] * 300))
    assert parser_of.cache_info().misses == 2 and shape("5. Oct 2018!") == "9. aaa 9999!"


def test_ambiguous_times_follow_their_file(spark):
    def file(name, start, seconds, zone):
        z = ZoneInfo(zone)
        return [(name, s * 1000, (t := datetime.fromtimestamp(start + s, timezone.utc).astimezone(z)).strftime("%Y-%m-%d"), t.strftime("%H:%M:%S"), "ymd", zone, 1, start + s) for s in seconds]

    back = 1635641999  # a second before the clock is put back in Oslo, 2021-10-31 01:00 UTC
    rows = file("a", back - 1200, [0, 600, 1300, 1900, 6000], "Europe/Oslo") + file("b", back - 1200, [0, 600, 1300, 1900], "Europe/Oslo") + file("c", back + 300, [0, 600, 6000], "Europe/Oslo")
    df = spark.createDataFrame(rows, "file string, start_ms bigint, d string, t string, o string, z string, utc_lo int, want bigint")
    got = instants_utc(df, keys=["file", "start_ms", "want"], file="file", run_ms="start_ms", date="d", time="t", order="o", zone="z", zones=["Europe/Oslo", "No/Where", None]).collect()
    assert len(got) == len(rows) and all(r.utc_ms == r.want * 1000 for r in got)
    assert instants_utc(df.limit(0), keys=["file"], file="file", run_ms="start_ms", date="d", time="t", order="o", zone="z", zones=["UTC"]).count() == 0


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Pacific/Apia", "Asia/Kolkata"])
def test_zone_tables_agree_with_the_database_in_all_years(zone):
    r, z, epoch = np.random.default_rng(2), ZoneInfo(zone), datetime(1970, 1, 1)
    local = [datetime(int(r.integers(1800, 3000)), int(r.integers(1, 13)), int(r.integers(1, 29)), int(r.integers(0, 24)), 30) for _ in range(500)] + [datetime(1945, 7, 1, 12)]
    lo, hi = to_utc(np.array([int((t - epoch).total_seconds()) * 1000 for t in local]), zone_table(zone))
    for t, a, b in zip(local, lo, hi, strict=True):
        want = sorted(int((t.replace(tzinfo=z, fold=f) - epoch.replace(tzinfo=timezone.utc)).total_seconds()) * 1000 for f in (0, 1))
        assert a == NONE or [a, b] == want, t
    if zone == "Europe/Berlin":
        assert iso_ms(lo[-1:])[0] == "1945-07-01T09:00:00.000Z"
