"""The read interface: answers as plain Python values, for dashboards.

Every method is one composed plan that ends in a collect of its own small answer: bins, tables, drill-downs of one sector
or cluster, or a view of at most 300 frames. The raw values of histograms are binned before they are collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import analytics as A
from tidemark.operators import graph as G
from tidemark.operators.filters import FilterOptions, findings, of_inspections
from tidemark.runtime import table


@dataclass
class InspectionGraph:
    inspections: DataFrame
    frames: DataFrame
    similar: DataFrame
    clusters: DataFrame
    in_cluster: DataFrame
    in_mosaic: DataFrame | None = None
    parts: DataFrame | None = None  # vis_code and, for the table by name, name
    ships: DataFrame | None = None  # imo, name
    mosaics: DataFrame | None = None  # mosaic_id, marine_growth_percentage, ship_hull_percentage

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "InspectionGraph":
        t = lambda n: table(spark, path, n).distinct()
        return cls(t("inspections"), t("frames"), t("similar_frames"), t("clusters"), t("in_cluster"))

    def get_inspections(self) -> dict[str, int]:
        """Title to id; of several inspections of one title the least id."""
        i = self.inspections.select(S.title("imo", "date").alias("t"), "inspection_id").filter("t is not null").groupBy("t").agg(F.min("inspection_id").alias("i"))
        return {r.t: r.i for r in i.collect()}

    def get_frames_angle(self, inspection_id: int, heading: int, options: FilterOptions | None = None) -> list[dict]:
        rows = A.frames_of_sector(self.frames, self.inspections, inspection_id, heading, options or FilterOptions(), self.in_mosaic)
        return [r.asDict() for r in rows.collect()]

    def get_frames_cluster(self, inspection_id: int, cluster: int) -> list[dict]:
        return [{"path": r.path, "uciqe": r.uciqe} for r in A.frames_of_cluster(self.frames, self.in_cluster, f"c{inspection_id}.{cluster}").collect()]

    def get_graph(self, options: FilterOptions) -> dict[str, set]:
        spark = self.frames.sparkSession
        parts = self.parts if self.parts is not None else spark.createDataFrame([(c,) for c in sorted(set(G.DEPICTS.values()))], "vis_code string")
        v = G.view(self.frames, self.similar, self.in_cluster, self.clusters, self.in_mosaic, None, parts, options)
        return {k: {tuple(r) for r in d.collect()} for k, d in v.items()}

    def get_histogram_data(self, options: FilterOptions, widths: dict[str, float] | None = None) -> dict[str, list[tuple[float, int]]]:
        h = A.histogram_values(self.frames, self.similar, options, self.in_mosaic, self.mosaics)
        w = {"growth": 5.0, "uciqe": 0.25, "depth": 0.5, "similar": 0.1, "visually_similar": 0.25} | (widths or {})
        out = {}
        for name, d in h.items():
            out[name] = sorted((r.bin, r["count"]) for r in A.value_histogram(d, d.columns[0], w[name]).collect())
        return out

    def get_headings_hist(self, options: FilterOptions) -> dict[int, dict]:
        f = of_inspections(self.frames, options).filter(findings(options))
        rows = A.nested_headings(A.heading_histogram(f, self.inspections)).collect()
        return {r.inspection_id: {"ship_name": r.imo, "ship_heading": r.ship_heading, "date": r.date, "data": [x.asDict() for x in r.data]} for r in rows}

    def get_tables(self, options: FilterOptions) -> tuple[list[dict], list[dict]]:
        f = of_inspections(self.frames, options).filter(findings(options))
        ships = A.defect_table(f, ["imo"]) if self.ships is None else A.by_ship(f, self.inspections, self.ships)
        named = self.parts if self.parts is not None and "name" in self.parts.columns else None
        return [r.asDict() for r in ships.collect()], [r.asDict() for r in A.by_part(f, G.depicts_of(f), named).collect()]

    def get_cluster_table(self, options: FilterOptions) -> list[dict]:
        f = of_inspections(self.frames, options)
        rows = A.cluster_table(f, self.in_cluster, self.clusters).withColumn("id", S.row_id("cluster", "inspection_id")).orderBy("cluster", "inspection_id")
        return [r.asDict() for r in rows.collect()]
