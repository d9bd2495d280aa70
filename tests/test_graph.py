import math

from pyspark.sql import functions as F
from tidemark.functions import scalars as S
from tidemark.model import LABELS
from tidemark.operators import analytics as A
from tidemark.operators import graph as G
from tidemark.operators.filters import FilterOptions, findings, of_inspections, without_suffix


def frames(spark, rows):
    """rows: id, inspection, number, uciqe, heading, labels seen (dict)."""
    cols = "frame_id string, inspection_id int, imo string, framenumber double, thumbnail string, uciqe double, heading double, depth double, " + ", ".join(f"{x} int, {x}_classification double, {x}_segmentation double" for x in LABELS)
    return spark.createDataFrame([(i, ins, "imo", n, f"t/{i}", q, h, 1.0, *[v for x in LABELS for v in (seen.get(x, 0), 0.0, 0.0)]) for i, ins, n, q, h, seen in rows], cols)


def test_findings(spark):
    f = frames(spark, [("a", 1, 0.0, 5.0, 0.0, {"corrosion": 1}), ("b", 1, 1.0, 5.0, 0.0, {"corrosion": None}), ("c", 1, 2.0, None, 0.0, {"corrosion": 2}), ("d", 1, 3.0, math.nan, 0.0, {"corrosion": 2}), ("e", 1, 4.0, -1.0, 0.0, {"corrosion": 2}), ("f", 2, 5.0, 3.0, 0.0, {"corrosion": 1, "anode": 1})])
    ids = lambda o, **k: [r.frame_id for r in f.filter(findings(o, **k)).orderBy("frame_id").collect()]
    assert ids(FilterOptions()) == ["a", "b"] and ids(FilterOptions(), ignore_quality=True) == ["a", "b", "f"]
    assert ids(FilterOptions(defects=("corrosion",)), ignore_quality=True) == ["a", "f"]
    assert ids(FilterOptions(defects=("corrosion",), parts=("anode", "propeller")), ignore_quality=True) == ["f"]
    assert of_inspections(f, FilterOptions(inspections=())).count() == 0 and of_inspections(f, FilterOptions(inspections=(2,))).count() == 1
    assert FilterOptions.column("Marine growth") == "marine_growth"
    assert without_suffix(spark.range(1).selectExpr("1 as a", "2 as b_coco")).columns == ["a"]


def test_base_is_in_text_order(spark):
    f = frames(spark, [(i, 7, 0.0, 5.0, 0.0, {}) for i in ("7.0.0", "7.30.0", "7.120.0", "7.1200.0")])
    assert [r.frame_id for r in G.base_frames(f, FilterOptions()).collect()] == ["7.0.0", "7.120.0", "7.1200.0", "7.30.0"]


def test_heading_bins(spark):
    d = spark.createDataFrame([(0.0, 300.0), (0.0, None), (359.0, 0.0), (14.9, 0.0), (15.0, 0.0)], "h double, s double")
    got = [(r.a, r.b) for r in d.select(S.heading_bin("h", "s").alias("a"), S.heading_bin("h", "s", faithful=True).alias("b")).collect()]
    assert got == [(240, -120), (180, 180), (180, 180), (180, 180), (210, 210)]


def test_cluster_table(spark):
    f = frames(spark, [("1.0", 1, 0.0, 5.0, 0.0, {"anode": 1, "defect": 1}), ("1.1", 1, 1.0, 6.0, 0.0, {"anode": 1}), ("1.2", 1, 2.0, 6.0, 0.0, {}), ("2.0", 2, 3.0, -1.0, 0.0, {})])
    m = spark.createDataFrame([("1.0", "c1.0"), ("1.1", "c1.0"), ("1.2", "c1.0"), ("1.2", "c1.0"), ("2.0", "c2.0"), ("2.0", "c2.-1"), ("2.0", "c2.n")], "frame_id string, cluster_id string")
    c = spark.createDataFrame([("c1.0", 1, 0), ("c2.0", 2, 0), ("c2.-1", 2, -1), ("c2.n", 2, None)], "cluster_id string, inspection_id int, number int")
    got = {r.inspection_id: r for r in A.cluster_table(f, m, c).collect()}
    assert set(got) == {1, 2} and (got[1]["size"], got[1].key_frame, got[1].keywords, got[1].first_frame) == (3, "t/1.2", "anode", 0.0)
    assert got[2].key_frame == "" and got[2].keywords == ""


def test_edges(spark):
    e = spark.createDataFrame([("a", "b", True, 0.5), ("b", "a", True, 0.5), ("a", "a", True, 0.0), ("a", "c", False, None), ("a", "d", True, math.nan)], "src string, dst string, visual boolean, distance double")
    assert G.undirected(G.near_edges(e, 1.0, True)).count() == 6
    into = spark.createDataFrame([("a", "M"), ("b", "M"), ("b", "N")], "f string, m string")
    assert {(r.src, r.dst) for r in G.contract(e, into, "f", "m").collect()} == {("M", "M"), ("M", "c"), ("M", "d")}
    assert G.among(e, spark.createDataFrame([("a",), ("b",)], "id string")).count() == 3
    s = G.simple_graph([(e.filter("visual"), 0.6), (e, 0.1)])
    assert {(r.a, r.b): r.weight for r in s.collect()} == {("a", "b"): 0.1, ("a", "a"): 0.1, ("a", "c"): 0.1, ("a", "d"): 0.1}


def test_view_without_inspections_is_empty(spark):
    f = frames(spark, [("a", 1, 0.0, 5.0, 0.0, {"anode": 1})])
    e = spark.createDataFrame([("a", "b", True, 0.5)], "src string, dst string, visual boolean, distance double")
    m = spark.createDataFrame([("a", "c1.0")], "frame_id string, cluster_id string")
    c = spark.createDataFrame([("c1.0", 1, 0)], "cluster_id string, inspection_id int, number int")
    mo = spark.createDataFrame([("a", "m1")], "frame_id string, mosaic_id string")
    parts = spark.createDataFrame([("102.2",)], "vis_code string")
    v = lambda o: {k: d.count() for k, d in G.view(f, e, m, c, mo, G.depicts_of(f), parts, o).items()}
    assert set(v(FilterOptions(inspections=())).values()) == {0}
    assert v(FilterOptions(mosaics=True)) == {"nodes": 1, "similar_to": 0, "visually_similar_to": 1, "in_inspection": 1, "in_mosaic": 1, "in_cluster": 1, "shows_part": 1, "part_of_ship": 1}


def test_scalars(spark):
    d = spark.createDataFrame([("x", math.inf, [1.0, 2.0]), ("5", math.nan, [0.0, 0.0]), (None, None, [900.0, -900.0])], "t string, v double, xs array<double>")
    r = d.select(S.sanitize("t").alias("a"), S.sanitize("v").alias("b"), F.aggregate(S.softmax("xs"), F.lit(0.0), lambda a, x: a + x).alias("c")).collect()
    assert [(x.a, x.b, round(x.c, 9)) for x in r] == [(0.0, 0.0, 1.0), (5.0, 0.0, 1.0), (0.0, 0.0, 1.0)]
    import hashlib

    want = (7984002041 + 46663 * sum(map(ord, hashlib.md5(b"ship").hexdigest()))) % 1_000_000
    one = spark.range(1).select(S.detid(F.lit("ship")).alias("d"), S.growth_ratio(F.lit(0.5), F.lit(0.04)).alias("g"), S.growth_ratio(F.lit(0.5), F.lit(0.1)).alias("h"), S.duration(F.lit(3723)).alias("t"), S.row_id(F.lit(3), F.lit(9)).alias("r"), S.node_kind(F.lit("p_s_1_2")).alias("k"), S.matrix_product(F.array(*[F.lit(float(i)) for i in range(9)]), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])).alias("m")).first()
    assert (one.d, one.g, one.h, one.t, one.r, one.k, one.m) == (want, 0.0, 100.0, "1h 2m 3s", "3=9", "part", [float(i) for i in range(9)])


def test_headings_nested(spark):
    f = frames(spark, [("a", 1, 0.0, 5.0, 0.0, {}), ("b", 1, 0.0, 5.0, 31.0, {}), ("c", 1, 0.0, 5.0, math.nan, {})])
    i = spark.createDataFrame([(1, "imo", "d", math.nan)], "inspection_id int, imo string, date string, ship_heading double")
    (r,) = A.nested_headings(A.heading_histogram(f, i)).collect()
    assert [(x.heading, x["count"]) for x in r.data] == [(180, 1), (210, 1)]
    assert A.frames_of_sector(f, i, 1, 210, FilterOptions()).collect()[0].path == "t/b"
    m = spark.createDataFrame([("b", "m1")], "frame_id string, mosaic_id string")
    assert A.frames_of_sector(f, i, 1, 210, FilterOptions(mosaics=True), m).collect()[0].path == "m1"
    s = A.summary(f, ["inspection_id"], "heading").first()
    assert (s.samples, s.mean) == (2, 15.5)
