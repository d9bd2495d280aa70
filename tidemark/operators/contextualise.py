"""The enrichment of a graph: similarity edges by telemetry and by image, and density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import components, project, standardise
from tidemark.operators.neighbours import cluster_nodes, density_clusters, k_nearest
from tidemark.runtime import cut

# Neighbours of each frame, components of an image vector, radius and least size of a density cluster.
NEIGHBOURS, COMPONENTS, EPS, LEAST = 4, 50, 61.4, 5


def contextualise(features: DataFrame, *, tel_width: int = 5, img_width: int = 512, k: int = NEIGHBOURS, eps: float = EPS, least: int = LEAST) -> dict[str, DataFrame]:
    """``similar`` (src, dst, visual, distance), ``clusters`` and ``in_cluster`` of features (frame_id, inspection_id, tel, img).

    All within an inspection: telemetry neighbours in standardised coordinates; visual neighbours by the principal components
    of the image vectors; clusters of the raw telemetry next to those components. Frames whose vectors are null, of another
    width or not finite take no part; a repeated frame counts once.
    """
    ok = lambda c, n: (F.size(c) == n) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    f = features.select("frame_id", "inspection_id", F.col("tel").cast("array<double>").alias("tel"), F.col("img").cast("array<double>").alias("img"))
    f = f.filter("frame_id is not null and inspection_id is not null").filter(ok("tel", tel_width) & ok("img", img_width)).dropDuplicates(["frame_id"])
    axes = components(f, "inspection_id", "img", COMPONENTS)
    # centring doesn't change distances, so vectors are projected as they are
    reduced = cut(project(f, axes, "inspection_id", "img").select("frame_id", "inspection_id", "tel", "reduced"))
    near = lambda d, v: k_nearest(d, id="frame_id", group="inspection_id", vector=v, k=k).select("src", "dst", "distance")
    tel = near(standardise(reduced, "inspection_id", "tel", tel_width), "scaled").withColumn("visual", F.lit(False))
    img = near(reduced, "reduced").withColumn("visual", F.lit(True))
    joined = reduced.withColumn("v", F.concat("tel", "reduced"))
    clusters, members = cluster_nodes(density_clusters(joined, id="frame_id", group="inspection_id", vector="v", eps=eps, least=least))
    return {"similar": tel.unionByName(img).select("src", "dst", "visual", "distance"), "clusters": clusters, "in_cluster": members}
