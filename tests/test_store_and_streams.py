import json

import pytest
from pyspark.sql import functions as F
from tidemark.sources import store
from tidemark.sources.overlay import instants
from tidemark.streaming.mosaics import sessions, stream_segments, windows


def test_upserts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k int, v string")
    rows = lambda d: sorted((r.k, r.v) for r in d.collect())
    assert rows(store.upsert(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "w")]
    assert rows(store.upsert(a, b, ["k"], update=True)) == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(Exception, match="the key exists"):
        store.upsert(a, b, ["k"], fail_on_exists=True).collect()
    assert store.upsert(a, b.filter("k = 3"), ["k"], fail_on_exists=True).count() == 3
    assert store.checked(b, spark.range(5).select(F.col("id").cast("int").alias("k")), "k").count() == 3
    with pytest.raises(Exception, match="not one parent"):
        store.checked(b, a, "k").collect()
    assert store.truncate(a).count() == 0 and store.attach(a, b).count() == 4


def test_cascade(spark):
    t = {
        "inspections": spark.createDataFrame([(1,), (2,)], "inspection_id int"), "frames": spark.createDataFrame([("a", 1), ("b", 2)], "frame_id string, inspection_id int"),
        "in_mosaic": spark.createDataFrame([("a", "m1"), ("b", "m2")], "frame_id string, mosaic_id string"), "mosaics": spark.createDataFrame([("m1",), ("m2",)], "mosaic_id string"),
        "similar": spark.createDataFrame([("a", "b"), ("b", "b")], "src string, dst string"), "in_cluster": spark.createDataFrame([("a", "c")], "frame_id string, cluster_id string"),
    }
    left = {k: v.count() for k, v in store.delete_inspections(t, spark.createDataFrame([(1,)], "inspection_id int")).items()}
    assert left == {"inspections": 1, "frames": 1, "in_mosaic": 1, "mosaics": 1, "similar": 1, "in_cluster": 0}
    assert store.delete_similarities(t["similar"], t["frames"], [1]).count() == 1
    assert store.delete_similarities(t["similar"], t["frames"], []).count() == 2 and store.delete_similarities(t["similar"], t["frames"]).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    for n in ("b.mp4", "b.ass", "deep/er/a.mp4", "deep/er/a.ass", "c.mp4"):
        (tmp_path / n).write_text("x")
    (tmp_path / "b.ass").write_text("[Events]\nDialogue: 0,0:00:01.25,0:00:02.00,Default,,0,0,0,,{\\an7}Depth:\\NPitch:\nDialogue: 0,0:00:01.25,0:00:02.00,Default,,0,0,0,,{\\an7}5 m\\N1,5\nComment: no\n")
    assert [r.path.rsplit("/", 1)[1] for r in store.video_files(spark, str(tmp_path)).collect()] == ["b.mp4", "a.mp4"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.video_files(spark, str(tmp_path / "none")).collect()
    (r,) = instants(store.overlay_events(spark, str(tmp_path / "b.ass"))).collect()
    assert (r.file, r.start_ms, [(x.key, x.value) for x in r.readings]) == ("b.ass", 1250, [("Depth", "5 m"), ("Pitch", "1,5")])
    (tmp_path / "m.json").write_text(json.dumps({"inspection_date": "2020-01-01", "ship_name": "unknown", "imo": "1"}))
    m = store.metadata(spark, str(tmp_path / "m.json")).first()
    assert m.missing == ["ship_name", "ship_type", "marine_traffic_url"] and 0 <= m.inspection_id < 1_000_000
    store.save(spark.range(3), str(tmp_path / "out"))
    store.save_statistics(spark.range(3), str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and spark.read.json(str(tmp_path / "stats")).count() == 3


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streamed_mosaics(spark, tmp_path):
    rows = [(1, k, k not in (5, 9), 2.0) for k in range(12)] + [(2, k, k != 3, 1.0) for k in range(6)]
    schema = "inspection_id int, frame_index bigint, ok boolean, size_increase double"
    for part in (0, 1, 2):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {(r.inspection_id, r.start_frame, r.end_frame, r.frames) for r in run_stream(spark, stream_segments(s), "tm_mosaics")}
    assert got == {(1, 0, 5, 5), (1, 6, 9, 3)}


def test_sessions_and_windows(spark, tmp_path):
    d = spark.sql("SELECT u, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) AS ts FROM VALUES (1, 0), (1, 3), (1, 20), (2, 0) AS t(u, m)")
    got = {(r.u, str(r.start), r["count"]) for r in sessions(d, "ts", "u").collect()}
    assert got == {(1, "2024-01-01 00:00:00", 2), (1, "2024-01-01 00:20:00", 1), (2, "2024-01-01 00:00:00", 1)}
    assert windows(d, "ts", "u", "10 minutes").count() == 3 and windows(d, "ts", "u", "10 minutes", "5 minutes").count() == 6
    late = spark.sql("SELECT 9 AS u, timestamp'2024-01-02 00:00:00' AS ts")
    d.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "e"))
    assert {(r.u, r["count"]) for r in run_stream(spark, sessions(s, "ts", "u"), "tm_sessions")} >= {(1, 2), (1, 1), (2, 1)}


def test_clearing_similarities_and_what_is_missing(spark):
    t = {
        "frames": spark.createDataFrame([("1.0", 1), ("1.1", 1), ("2.0", 2)], "frame_id string, inspection_id int"),
        "similar": spark.createDataFrame([("1.0", "2.0"), ("2.0", "1.0"), (None, "1.0")], "src string, dst string"),
        "clusters": spark.createDataFrame([("c1.0", 1), ("c2.0", 2), ("c3.0", 3)], "cluster_id string, inspection_id int"),
        "in_cluster": spark.createDataFrame([("1.1", "c1.0"), ("2.0", "c2.0"), ("2.0", None)], "frame_id string, cluster_id string"),
    }
    left = {k: sorted(map(tuple, d.collect()), key=str) for k, d in store.delete_context(t, [1]).items()}
    assert left["similar"] == [("2.0", "1.0"), (None, "1.0")] and [c[0] for c in left["clusters"]] == ["c2.0", "c3.0"] and len(left["in_cluster"]) == 2 and len(left["frames"]) == 3
    assert [d.count() for k, d in store.delete_context(t).items() if k != "frames"] == [0, 0, 0]
    assert store.delete_context(t, [])["similar"].count() == 3
    have = spark.createDataFrame([("1.0",)], "frame_id string")
    assert sorted(r.frame_id for r in store.missing(t["frames"].union(t["frames"]), have, ["frame_id"]).collect()) == ["1.1", "2.0"]
