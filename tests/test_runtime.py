from types import SimpleNamespace

import pytest
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from tidemark.runtime import cut, map_segments, ranked_blocks


def test_segments_are_whole_across_batches(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 7 == 3, 0).otherwise(F.col("id") % 3).alias("j"), "id").union(spark.range(5000, 9000).selectExpr("100 as k", "0 as j", "id"))

    def count(batch, starts):
        n = np.diff(np.r_[starts, len(batch)])
        return pd.DataFrame({"k": batch.k.to_numpy()[starts], "j": batch.j.to_numpy()[starts], "n": n})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.k, r.j): r.n for r in map_segments(df, ["k", "j"], ["id"], count, "k bigint, j bigint, n bigint").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(r.k, r.j): r.n for r in df.groupBy("k", "j").agg(F.count("*").alias("n")).collect()}


def test_ranked_blocks(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), (F.col("id") * 3).alias("o"))
    rows = ranked_blocks(df, ["k"], ["o"], F.floor(F.col("o") / 50), 30, 4).toPandas()
    own = rows[rows.own].sort_values("o")
    assert own.idx.tolist() == list(range(100)) and (own.block == own.idx // 30).all()
    assert set(rows[(rows.block == 1) & ~rows.own].idx) == {26, 27, 28, 29, 60, 61, 62, 63}


@pytest.mark.parametrize(("master", "folder", "raises"), [("spark://somewhere:7077", None, True), ("local-cluster[2,1,1024]", None, True), ("local[4]", None, False), ("yarn", "hdfs:/x", False)])
def test_a_cluster_needs_a_shared_folder(master, folder, raises):
    made = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda name, other: folder)), checkpoint=lambda eager: "done")
    if raises:
        with pytest.raises(RuntimeError, match="checkpoint"):
            cut(df)
    else:
        assert cut(df) == "done" and len(made) == 1 and made[0] == (folder or made[0])
