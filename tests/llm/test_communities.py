import numpy as np
from tidemark.llm.communities import clusters, describe, modularity_communities, neighbour_descent, same_cluster_pairs


def made(n, seed=0, d=16):
    r = np.random.default_rng(seed)
    places = r.normal(0, 4, (max(2, n // 25), d))
    x = places[r.integers(0, len(places), n)] + r.normal(0, 0.15, (n, d))
    chain = np.zeros((20, d))
    chain[:, 0] = 50 + np.arange(20) * 1.2  # held together by steps alone
    return np.concatenate([x, chain]).astype(np.float32)


def brute(x, reach):
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2)) <= reach
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(d, label[None], len(x)).min(1)
        if (new == label).all():
            break
        label = new
    return label


def check(spark, whole):
    rows, want = [], set()
    for g, n in ((1, 120), (2, 300), (3, 6)):
        x = made(n, seed=g)
        ids = [f"g{g}.{i:04d}" for i in range(len(x))]
        rows += [(ids[i], g, x[i].tolist()) for i in range(len(x))]
        label = brute(x, 1.5)
        for c in np.unique(label):
            m = np.flatnonzero(label == c)
            if len(m) >= 5:
                want |= {(ids[a], ids[b]) for a in m for b in m if ids[a] < ids[b]}
    rows += [rows[0], ("null", 1, None), ("short", 1, [1.0]), (None, 1, rows[0][2]), ("nogroup", None, rows[0][2])]
    df = spark.createDataFrame(rows, "frame_id string, inspection_id int, img array<float>")
    found = clusters(df, id="frame_id", group="inspection_id", vector="img", dimensions=16, whole=whole)
    assert {(r.a, r.b) for r in same_cluster_pairs(found).collect()} == want
    return found


def test_small_groups_whole(spark):
    found = check(spark, 4096)
    q = spark.createDataFrame([("g1.0000", 3.0, 1.0), ("g1.0001", float("nan"), 2.0), ("g1.0001", float("nan"), 2.0)], "frame_id string, uciqe double, depth double")
    d = describe(found, q, id="frame_id", quality="uciqe", depth="depth").collect()
    assert sum(r["size"] for r in d) == sum(1 for _ in found.join(spark.createDataFrame([(r.cluster,) for r in d], "cluster string"), "cluster").collect())
    assert all(1 <= len(r.typical) <= 3 for r in d) and sum(len(r.best) for r in d) == 1


def test_large_groups_in_blocks(spark):
    check(spark, 50)


def test_neighbour_descent_recall():
    x = made(900, seed=4).astype(float)
    near, _ = neighbour_descent(x, 8)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(near, true)]) >= 0.9


def test_modularity():
    a = np.array([0, 0, 1, 3, 3, 4, 2])
    b = np.array([1, 2, 2, 4, 5, 5, 3])
    c = modularity_communities(6, a, b, np.ones(7))
    assert len(set(c[:3])) == 1 and len(set(c[3:])) == 1 and c[0] != c[3]
    assert (modularity_communities(3, a[:0], b[:0], np.ones(0)) == np.arange(3)).all()


def test_empty(spark):
    df = spark.createDataFrame([], "frame_id string, inspection_id int, img array<float>")
    assert clusters(df, id="frame_id", group="inspection_id", vector="img").count() == 0


def test_groups_are_the_same_in_one_task_and_in_many(spark):
    """Graph, communities and typical members must not depend on which way a group goes."""
    rows = []
    for g, n in ((1, 300), (2, 60)):
        r = np.random.default_rng(g)
        line = np.cumsum(np.r_[0, r.choice([0.35, 0.7, 1.3], 119)])  # one cluster of several communities
        x = np.concatenate([made(n, seed=g), np.c_[line + 100, r.normal(0, 0.02, (120, 15))].astype(np.float32), np.repeat(made(1, seed=9)[:1], 30, 0)])
        rows += [(f"g{g}.{i:04d}", g, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "frame_id string, inspection_id int, img array<float>")
    q = df.selectExpr("frame_id", "cast(hash(frame_id) as double) uciqe", "1.0D depth")
    got = {}
    for whole in (4096, 40):
        found = clusters(df, id="frame_id", group="inspection_id", vector="img", dimensions=16, whole=whole).cache()
        got[whole] = {tuple(r) for r in found.collect()}, {str(r) for r in describe(found, q, id="frame_id", quality="uciqe", depth="depth").collect()}
    assert got[40] == got[4096]
    assert max(int(s.split("communities=")[1].split(",")[0]) for s in got[40][1]) > 1
