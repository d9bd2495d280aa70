import numpy as np
import pytest
from tidemark import cli
from tidemark.api import InspectionGraph
from tidemark.operators.contextualise import contextualise
from tidemark.operators.filters import FilterOptions


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    from test_graph import frames

    d = str(tmp_path_factory.mktemp("graph"))
    frames(spark, [("1.0", 1, 0.0, 5.0, 0.0, {"anode": 1, "defect": 1}), ("1.1", 1, 1.0, 6.0, 31.0, {"anode": 1}), ("2.0", 2, 0.0, 1.0, 0.0, {})]).write.parquet(f"{d}/frames.parquet")
    spark.createDataFrame([(1, "imo", "2020", 0.0), (2, "imo", None, 0.0)], "inspection_id int, imo string, date string, ship_heading double").write.parquet(f"{d}/inspections.parquet")
    spark.createDataFrame([("1.0", "1.1", True, 0.5), ("1.0", "2.0", False, 9.0)], "src string, dst string, visual boolean, distance double").write.parquet(f"{d}/similar_frames.parquet")
    spark.createDataFrame([("c1.0", 1, 0)], "cluster_id string, inspection_id int, number int").write.parquet(f"{d}/clusters.parquet")
    spark.createDataFrame([("1.0", "c1.0"), ("1.1", "c1.0")], "frame_id string, cluster_id string").write.parquet(f"{d}/in_cluster.parquet")
    return d


def test_reads(spark, tables):
    g, o = InspectionGraph.read(spark, tables), FilterOptions()
    assert g.get_inspections() == {"imo on 2020": 1}
    assert g.get_frames_angle(1, 210) == [{"path": "t/1.1", "uciqe": 6.0}]
    assert [r["path"] for r in g.get_frames_cluster(1, 0)] == ["t/1.0", "t/1.1"]
    v = g.get_graph(o)
    assert len(v["nodes"]) == 2 and v["visually_similar_to"] == {("im_1.0", "im_1.1"), ("im_1.1", "im_1.0")} and v["part_of_ship"] == {("p_s_imo_102.2", "s_imo")}
    assert g.get_histogram_data(o)["similar"] == [(9.0, 2)]
    assert [x["count"] for x in g.get_headings_hist(o)[1]["data"]] == [1, 1]
    ships, parts = g.get_tables(o)
    assert ships == [{"imo": "imo", "defect": 1, "corrosion": 0, "marine_growth": 0, "paint_peel": 0}] and parts[0]["vis_code"] == "102.2"
    (row,) = g.get_cluster_table(o)
    assert (row["id"], row["key_frame"], row["keywords"]) == ("0=1", "t/1.1", "anode defect")
    assert all(not x for x in g.get_graph(FilterOptions(inspections=())).values())


def test_commands(spark, tables, tmp_path):
    assert cli.main(["clear", tables, str(tmp_path / "out"), "1"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/frames.parquet")).count() == 1 and spark.read.parquet(str(tmp_path / "out/similar_frames.parquet")).count() == 0
    (tmp_path / "m.json").write_text('{"imo": "1"}')
    assert cli.main(["analyze", str(tmp_path / "m.json")], spark) == 1
    (tmp_path / "v.mp4").write_text("x")
    assert cli.main(["list", str(tmp_path)], spark) == 0
    assert cli.main(["analyze", str(tmp_path / "m.json"), "--select", "1,2", "--dry-run"], spark) == 0  # there is only one
    assert cli.main(["clear", tables, str(tmp_path / "sim"), "1", "--similarities"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "sim/frames.parquet")).count() > 1 and spark.read.parquet(str(tmp_path / "sim/clusters.parquet")).count() == 0
    assert cli.main(["clear", tables, str(tmp_path / "none"), "--all"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "none/frames.parquet")).count() == 0
    with pytest.raises(SystemExit):
        cli.main(["clear", tables, str(tmp_path / "x")], spark)


def test_contextualise(spark):
    r = np.random.default_rng(0)
    rows = [(f"{g}.{i:02d}", g, [float(x) for x in r.normal(0, 1, 5)], [float(x) for x in r.normal(0, 1, 8)]) for g in (1, 2) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0], ("x", 1, None, None), ("y", 1, [1.0] * 5, [float("nan")] * 8)], "frame_id string, inspection_id int, tel array<double>, img array<float>")
    c = {k: d.collect() for k, d in contextualise(df, img_width=8).items()}
    assert len(c["similar"]) == 2 * 24 * 4 and len(c["in_cluster"]) == 24 and {x.number for x in c["clusters"]} == {0}
    img = {x[0]: np.array(x[3], np.float32) for x in rows}
    for x in c["similar"]:
        if x.visual:
            assert abs(np.linalg.norm(img[x.src] - img[x.dst]) - x.distance) < 1e-5
