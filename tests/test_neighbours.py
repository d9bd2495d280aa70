import numpy as np
import pandas as pd
import pytest
from tidemark.operators.components import connected, pieces
from tidemark.operators.features import components, project, standardise, telemetry_vector
from tidemark.operators.neighbours import cluster_nodes, density_clusters, k_nearest


def sequential(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= least
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] >= 0:
                    continue
                label[j] = n
                if core[j]:
                    todo += [k for k in np.flatnonzero(d[j]) if label[k] < 0]
            n += 1
    return core, label


def frame(spark, groups):
    rows = [(f"{g}.{i:03d}", g, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, rows[0], (None, 1, [0.0, 0.0]), ("n", 1, None), ("q", 1, [float("nan"), 0.0])], "id string, g int, v array<double>")


@pytest.mark.parametrize("block", [2048, 20])
def test_density_clusters(spark, block):
    r = np.random.default_rng(2)
    groups = {g: r.uniform(0, 10, (90, 2)).round(2) for g in (1, 2)}
    got = {x.id: (x.core, x.number) for x in density_clusters(frame(spark, groups), id="id", group="g", vector="v", eps=0.9, least=5, block=block).collect()}
    for g, x in groups.items():
        core, label = sequential(x, 0.9, 5)
        assert [got[f"{g}.{i:03d}"] for i in range(90)] == list(zip(core.tolist(), label.tolist()))
    assert len(got) == 180


@pytest.mark.parametrize("block", [2048, 25])
def test_k_nearest(spark, block):
    r = np.random.default_rng(1)
    groups = {1: r.integers(0, 6, (70, 2)).astype(float), 2: r.normal(0, 1, (3, 2))}
    got = {}
    for x in k_nearest(frame(spark, groups), id="id", group="g", vector="v", k=4, block=block).collect():
        got.setdefault(x.src, []).append((x["rank"], x.dst, round(x.distance, 6)))
    for g, x in groups.items():
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(6)
        for i in range(len(x)):
            want = sorted((d[i, j], f"{g}.{j:03d}") for j in range(len(x)) if j != i)[:4]
            assert [(n, dd) for _, n, dd in sorted(got[f"{g}.{i:03d}"])] == [(n, dd) for dd, n in want]


def test_connected(spark):
    e = [("a", "b"), ("b", "c"), ("d", "d"), ("f", "e"), ("c", "z"), ("y", "x")] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]
    got = {r.u: r.label for r in connected(spark.createDataFrame(e, "u string, v string")).collect()}
    assert [got[k] for k in "abczdefxy"] == list("aaaadeexx") and {got[f"p{i:02d}"] for i in range(41)} == {"p00"}
    assert pieces(5, np.array([4, 1]), np.array([2, 0])).tolist() == [0, 0, 2, 3, 2]
    assert connected(spark.createDataFrame([], "u string, v string")).count() == 0


def test_features(spark):
    d = spark.createDataFrame([(1, 2.0, 90.0, float("nan"), 30.0), (1, None, 0.0, 1.0, 60.0), (2, 5.0, None, 1.0, 0.0)], "g int, depth double, heading double, camera_tilt double, framenumber double")
    v = telemetry_vector(d)
    assert [[round(y, 6) for y in r.tel] for r in v.orderBy("g", "framenumber").collect()] == [[2, 1, 0, 0, 30], [0, 0, 1, 1, 60], [5, 0, 1, 1, 0]]
    z = {(r.g, r.framenumber): r.scaled for r in standardise(v, "g", "tel", 5).collect()}
    assert z[1, 30.0][0] == 1.0 and z[2, 0.0] == [0.0] * 5


def test_components(spark):
    x = np.random.default_rng(0).normal(0, 1, (60, 6)) * [3, 1, 1, 0.5, 0.1, 0]
    df = spark.createDataFrame(pd.DataFrame({"g": [1] * 60, "v": list(x.tolist())}))
    c = components(df, "g", "v", 3).first()
    want = np.linalg.svd(x - x.mean(0))[1][:3] ** 2 / 60
    assert np.allclose(c.variance, want) and len(c.axes) == 3
    p = np.array([r.reduced for r in project(df, components(df, "g", "v", 3), "g", "v").collect()])
    assert np.allclose(np.var(p, axis=0), want)
    assert len(components(df.limit(2), "g", "v", 50).first().variance) == 2


def test_components_of_a_hot_group_in_levels(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (3000, 5)) * [4, 2, 1, 0.5, 0.2] + 7
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(3000) < 2700, 1, 2), "v": list(x.tolist())})).repartition(130)
    for c in components(df, "g", "v", 5).collect():
        own = x[:2700] if c.g == 1 else x[2700:]
        val, vec = np.linalg.eigh(np.cov(own.T, bias=True))
        assert np.allclose(c.variance, val[::-1]) and np.allclose(np.abs(np.array(c.axes)), np.abs(vec[:, ::-1].T), atol=1e-6)


def test_cluster_nodes(spark):
    d = spark.createDataFrame([("a", 1, True, 0), ("b", 1, False, -1)], "id string, `group` int, core boolean, number int")
    nodes, edges = cluster_nodes(d)
    assert {r.cluster_id for r in nodes.collect()} == {"c1.0", "c1.-1"} and edges.count() == 2
