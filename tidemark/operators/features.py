"""Feature vectors, their standardisation and principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import sanitize


def telemetry_vector(df: DataFrame, out: str = "tel") -> DataFrame:
    """Depth, sine and cosine of the heading, camera tilt and frame number; what is no number counts as 0."""
    h = F.radians(sanitize("heading"))
    return df.withColumn(out, F.array(sanitize("depth"), F.sin(h), F.cos(h), sanitize("camera_tilt"), sanitize("framenumber")))


def standardise(df: DataFrame, group: str, vector: str, width: int, out: str = "scaled") -> DataFrame:
    """Each element less its group's mean, by its group's population deviation; 0 where that is 0.

    Statistics are aggregates with partial sums, joined back, and not a window that would gather the group.
    """
    e = lambda i: F.get(F.col(vector), F.lit(i)).cast("double")
    stats = df.groupBy(group).agg(*[f(e(i)).alias(f"{n}{i}") for i in range(width) for f, n in ((F.avg, "_m"), (F.stddev_pop, "_d"))])
    j = df.join(stats, group)
    scaled = F.array(*[F.when(F.col(f"_d{i}") > 1e-12, (e(i) - F.col(f"_m{i}")) / F.col(f"_d{i}")).otherwise(F.lit(0.0)) for i in range(width)])
    return j.withColumn(out, scaled).drop(*[f"{n}{i}" for i in range(width) for n in ("_m", "_d")])


#: Rows of vectors that a worker holds before it reduces them, and how many partial results are joined by one task.
HELD, FAN_IN = 20_000, 64


def components(df: DataFrame, group: str, vector: str, k: int = 50) -> DataFrame:
    """(group, variance ARRAY, axes ARRAY<ARRAY>): principal components of each group, at most k, n and d of them.

    Every partition is reduced, for each group, to its count, its sum and a triangular factor of its products, of no more rows than
    there are elements; ``FAN_IN`` partitions' factors are stacked and factored again, and so on in levels. So no task holds
    a group or more than so many factors. Each axis' largest element is positive. Vectors must be finite and of one length.
    """
    gkind = dict(df.dtypes)[group]
    schema = f"g {gkind}, p int, n bigint, s binary, r binary"

    def reduced(g, p: int, n: int, s: np.ndarray, r: np.ndarray) -> pd.DataFrame:  # noqa: ANN001
        r = r if len(r) <= r.shape[1] else np.linalg.qr(r, mode="r")
        return pd.DataFrame({"g": [g], "p": [p], "n": [n], "s": [s.tobytes()], "r": [np.ascontiguousarray(r).tobytes()]})

    def partial(batches):  # noqa: ANN001, ANN202
        held, rows, p = {}, 0, 0

        def out():  # noqa: ANN202
            for g, (n, s, parts) in held.items():
                yield reduced(g, p, n, s, np.concatenate(parts))

        for b in batches:
            for (g, p), own in b.groupby(["g", "p"], sort=False):
                x = np.stack(own.v.to_numpy()).astype(float)
                n, s, parts = held.get(g, (0, 0.0, []))
                if sum(map(len, parts)) + len(x) > 4 * x.shape[1]:
                    parts = [np.linalg.qr(np.concatenate([*parts, x]), mode="r")]
                else:
                    parts = [*parts, x]
                held[g] = (n + len(x), s + x.sum(0), parts)
                rows += len(x)
            if rows > HELD:
                yield from out()
                held, rows = {}, 0
        yield from out()

    def stacked(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        s = sum(np.frombuffer(x) for x in pdf.s)
        return int(pdf.n.sum()), s, np.concatenate([np.frombuffer(x).reshape(-1, len(s)) for x in pdf.r])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return reduced(pdf.g.iloc[0], int(pdf.p.iloc[0]), *stacked(pdf))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, r = stacked(pdf)
        mean = s / n
        if len(r) == n:  # the rows themselves
            _, val, vec = np.linalg.svd(r - mean, full_matrices=False)
            val = val**2 / n
        else:
            val, vec = np.linalg.eigh(r.T @ r / n - np.outer(mean, mean))
            val, vec = np.maximum(val[::-1], 0), vec[:, ::-1].T
        m = min(k, n, len(mean))
        val, vec = val[:m], vec[:m]
        vec = vec * np.sign(vec[np.arange(m), np.abs(vec).argmax(1)])[:, None]
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "variance": [val.tolist()], "axes": [vec.tolist()]})

    v = df.select(F.col(group).alias("g"), F.spark_partition_id().alias("p"), F.col(vector).alias("v")).filter("g is not null and v is not null")
    parts = v.mapInPandas(partial, schema)
    for _ in range(2):
        parts = parts.withColumn("p", F.expr(f"p div {FAN_IN}").cast("int")).groupBy("g", "p").applyInPandas(joined, schema)
    return parts.groupBy("g").applyInPandas(whole, f"g {gkind}, variance array<double>, axes array<array<double>>").withColumnRenamed("g", group)


def project(df: DataFrame, axes: DataFrame, group: str, vector: str, out: str = "reduced") -> DataFrame:
    """Each vector along its group's axes."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.join(axes.select(group, "axes"), group).withColumn(out, F.transform("axes", lambda a: dot(a, F.col(vector).cast("array<double>")))).drop("axes")
