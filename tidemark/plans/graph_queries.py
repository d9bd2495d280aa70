"""The inspection graph's queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.model import DEFECTS, DEPICTS, LABELS, PARTS
from tidemark.operators import analytics as A
from tidemark.operators import features as X
from tidemark.operators import graph as G
from tidemark.operators import mosaics as M
from tidemark.operators import neighbours as N
from tidemark.operators import series as T
from tidemark.operators import vision as V
from tidemark.operators.filters import FilterOptions, findings, of_inspections
from tidemark.runtime import table
from tidemark.sources import store
from tidemark.sources.overlay import instants
from tidemark.streaming.mosaics import sessions, windows

OPTS = FilterOptions(defects=("corrosion", "defect"), parts=("bilge_keel", "anode", "propeller"))
# The inspections of the queries that are about chosen ones.
CHOSEN = (100001, 100002, 100003, 100005, 100008)
NAMES = ["Alder", "Birch", "Cedar", "Elm", "Fir", "Hazel", "Larch", "Maple", "Oak", "Pine", "Rowan", "Willow"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def frames(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Frames, repeated rows once."""
    f = table(spark, d, "frames")
    return (f.select("frame_id", *columns) if columns else f).distinct()


def inspections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inspections").distinct()


def similar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "similar_frames").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features").select("frame_id", "inspection_id", "tel").filter("frame_id is not null and inspection_id is not null and tel is not null").dropDuplicates(["frame_id"])


def _in_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for the mosaics' frames, of which there is no table: the members of clusters of even number."""
    c = table(spark, d, "clusters").filter("number % 2 = 0").select("cluster_id").distinct()
    return table(spark, d, "in_cluster").join(c, "cluster_id", "left_semi").select("frame_id", F.concat(F.lit("m"), F.col("cluster_id")).alias("mosaic_id")).distinct()


def _mosaics(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for the mosaics: the percentages of their frames, added up."""
    f = frames(spark, d, "marine_growth_segmentation", "bilge_keel_segmentation").join(_in_mosaic(spark, d), "frame_id")
    part = lambda c: F.round(F.sum(F.when(~F.isnan(c), F.col(c))), 4)
    return f.groupBy("mosaic_id").agg(part("marine_growth_segmentation").alias("marine_growth_percentage"), part("bilge_keel_segmentation").alias("ship_hull_percentage"))


def _ships(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for the ships, of which there is no table."""
    return table(spark, d, "inspections").select("imo").filter("imo is not null").distinct().withColumn("name", S.pseudonym("imo", NAMES))


IN_MOSAIC = "SELECT DISTINCT frame_id, 'm' || cluster_id AS mosaic_id FROM in_cluster WHERE cluster_id IN (SELECT cluster_id FROM clusters WHERE number % 2 = 0)"
SEEN = "sum(CASE WHEN {0} > 0.8 THEN 1 ELSE 0 END)::BIGINT AS {0}"
FRAMES = "f AS (SELECT DISTINCT * FROM frames)"
INSPECTIONS = "i AS (SELECT DISTINCT * FROM inspections)"
EDGES = "e AS (SELECT DISTINCT * FROM similar_frames)"
FOUND = "(uciqe >= 4 AND NOT isnan(uciqe) AND (coalesce(bilge_keel > 0.8, false) OR coalesce(anode > 0.8, false) OR coalesce(propeller > 0.8, false)) AND (coalesce(corrosion > 0.8, false) OR coalesce(defect > 0.8, false)))"
DEP = " UNION ALL ".join(f"SELECT frame_id, '{x}' AS label, '{c}' AS vis_code, {x}_segmentation AS segmentation, {x}_classification AS classification FROM f WHERE {x} > 0.8" for x, c in DEPICTS.items())
BIN = "floor((heading - coalesce(CASE WHEN isnan(ship_heading) THEN NULL ELSE ship_heading END, 0.0) + 180) / 30 + 0.5) * 30"
SHIP_HEADING = "CASE WHEN isnan(ship_heading) THEN NULL ELSE ship_heading END"


# scans, lookups, lists


@query("SELECT imo || ' on ' || date AS title, min(inspection_id) AS inspection_id FROM inspections WHERE imo IS NOT NULL AND date IS NOT NULL GROUP BY 1")
def q_list_inspections(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "inspections").select(S.title("imo", "date").alias("title"), "inspection_id").filter("title is not null")
    return i.groupBy("title").agg(F.min("inspection_id").alias("inspection_id"))


@query("SELECT DISTINCT 'events' AS kind, event_type AS label FROM events UNION SELECT DISTINCT 'documents', lang FROM documents UNION SELECT DISTINCT 'recorders', recorder FROM recorders")
def q_catalog_labels(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("label")) for t, c in (("events", "event_type"), ("documents", "lang"), ("recorders", "recorder"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT * FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM clusters GROUP BY 1 HAVING count(*) = 1)")
def q_unique_lookup(spark: SparkSession, d: str) -> DataFrame:
    return A.unique_rows(table(spark, d, "clusters"), ["cluster_id"])


@query("SELECT src, dst, visual, distance FROM (SELECT *, count(*) OVER (PARTITION BY src, dst, visual) AS n FROM similar_frames) WHERE n = 1")
def q_unique_relation(spark: SparkSession, d: str) -> DataFrame:
    return A.unique_rows(table(spark, d, "similar_frames"), ["src", "dst", "visual"])


@query("""WITH e AS (SELECT file, start_ms, row_number() OVER (PARTITION BY file, start_ms ORDER BY event_no) AS n, string_split(regexp_replace(text, '^[^}]*\\}', ''), '\\N') AS l FROM (SELECT DISTINCT * FROM telemetry_raw)),
p AS (SELECT k.file, k.start_ms, unnest(k.l) AS key, unnest(v.l[:len(k.l)]) AS value FROM e k JOIN e v ON k.file = v.file AND k.start_ms = v.start_ms AND k.n % 2 = 1 AND v.n = k.n + 1)
SELECT file, start_ms, regexp_replace(trim(key), '\\s*:\\s*$', '') AS key, value FROM p WHERE key IS NOT NULL AND value IS NOT NULL""")
def q_parse_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return instants(table(spark, d, "telemetry_raw")).select("file", "start_ms", F.explode("readings").alias("r")).select("file", "start_ms", "r.key", "r.value")


# filters and projections


@query(f"WITH {FRAMES} SELECT frame_id, uciqe FROM f WHERE {FOUND}")
def q_findings_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frames").filter(findings(OPTS)).select("frame_id", "uciqe").distinct()


@query(f"WITH {FRAMES} SELECT frame_id, uciqe FROM f WHERE {FOUND.replace('uciqe >= 4', 'uciqe >= 0')}")
def q_findings_any_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frames").filter(findings(OPTS, ignore_quality=True)).select("frame_id", "uciqe").distinct()


@query("SELECT DISTINCT frame_id, cluster_id FROM in_cluster WHERE cluster_id NOT LIKE '%-1'")
def q_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "in_cluster").filter(~F.col("cluster_id").endswith("-1")).distinct()


@query(f"WITH {FRAMES} SELECT frame_id, framenumber FROM f WHERE CAST(framenumber AS BIGINT) % 90 = 0")
def q_decimate(spark: SparkSession, d: str) -> DataFrame:
    return T.decimate(frames(spark, d, "framenumber"), "framenumber", 90)


@query(f"WITH {FRAMES} SELECT frame_id, 'im_' || frame_id AS node, 'frame' AS kind, CASE WHEN thumbnail LIKE 'm%' THEN 'mosaics/' ELSE 'frames/' END || thumbnail AS path FROM f")
def q_node_ids(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "thumbnail").select("frame_id", S.node_id("im", "frame_id").alias("node"), S.image_path("thumbnail").alias("path"))
    return f.withColumn("kind", S.node_kind("node"))


# joins and the graph


@query(f"WITH {EDGES}, u AS (SELECT src, dst, distance FROM e WHERE visual AND distance < 1.0 AND NOT isnan(distance)) SELECT src, dst, distance FROM u UNION ALL SELECT dst, src, distance FROM u")
def q_undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(G.near_edges(similar(spark, d), 1.0, True)).select("src", "dst", "distance")


@query(f"WITH {EDGES} SELECT src, dst FROM e WHERE src IN (SELECT frame_id FROM in_cluster) AND dst IN (SELECT frame_id FROM in_cluster)")
def q_dangling_semi(spark: SparkSession, d: str) -> DataFrame:
    return G.among(similar(spark, d).select("src", "dst", "visual", "distance"), table(spark, d, "in_cluster"), node="frame_id").select("src", "dst")


@query(f"WITH {EDGES}, m AS (SELECT frame_id, min(cluster_id) AS w FROM in_cluster WHERE cluster_id IS NOT NULL GROUP BY 1) SELECT DISTINCT coalesce(a.w, src) AS src, coalesce(b.w, dst) AS dst FROM e LEFT JOIN m a ON src = a.frame_id LEFT JOIN m b ON dst = b.frame_id")
def q_edge_contraction(spark: SparkSession, d: str) -> DataFrame:
    return G.contract(similar(spark, d), table(spark, d, "in_cluster").filter("cluster_id is not null"), "frame_id", "cluster_id")


@query(f"WITH {EDGES}, k AS (SELECT src, dst, 0 AS n, 0.6 AS w FROM e WHERE visual UNION ALL SELECT src, dst, 1, 0.1 FROM e WHERE NOT visual UNION ALL SELECT frame_id, cluster_id, 2, 0.3 FROM in_cluster), r AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, n, w FROM k WHERE src IS NOT NULL AND dst IS NOT NULL) SELECT a, b, CAST(max_by(w, n) AS DOUBLE) AS weight FROM r GROUP BY 1, 2")
def q_simple_graph(spark: SparkSession, d: str) -> DataFrame:
    e = similar(spark, d).filter("src is not null and dst is not null")
    c = table(spark, d, "in_cluster").filter("frame_id is not null and cluster_id is not null").toDF("src", "dst")
    return G.simple_graph([(e.filter("visual"), 0.6), (e.filter("not visual"), 0.1), (c, 0.3)])


@query(f"WITH {EDGES}, k AS (SELECT src, dst FROM e UNION ALL SELECT DISTINCT frame_id, cluster_id FROM in_cluster) SELECT node, count(*) AS others FROM (SELECT src AS node FROM k UNION ALL SELECT dst FROM k) GROUP BY 1")
def q_union_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = G.neighbours([similar(spark, d), table(spark, d, "in_cluster").distinct().toDF("src", "dst")])
    return n.groupBy("node").agg(F.count(F.lit(1)).alias("others"))


@query("""WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS up FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'root' FROM region),
c AS (SELECT node, up AS ancestor, 1 AS hops FROM e UNION ALL SELECT c.node, e.up, c.hops + 1 FROM c JOIN e ON c.ancestor = e.node) SELECT node, ancestor, hops FROM c""")
def q_part_closure(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, d, "supplier").select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("up"))
    e = e.union(table(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(table(spark, d, "region").select(key("r", "r_regionkey"), F.lit("root")))
    return G.closure(e, "node", "up")


@query(f"WITH RECURSIVE p(vis_code, up) AS (VALUES {', '.join(f"('{a}', '{b or 'ship'}')" for a, b in PARTS)}), c AS (SELECT vis_code AS node, up AS ancestor, 1 AS hops FROM p UNION ALL SELECT c.node, p.up, hops + 1 FROM c JOIN p ON c.ancestor = p.vis_code), {FRAMES}, dep AS ({DEP}) SELECT DISTINCT frame_id, ancestor, hops FROM dep JOIN c ON dep.vis_code = c.node")
def q_parts_shown(spark: SparkSession, d: str) -> DataFrame:
    """Each frame with the parts above those that it shows, up to the ship."""
    p = spark.createDataFrame([(a, b or "ship") for a, b in PARTS], "vis_code string, up string")
    c = G.closure(p, "vis_code", "up").withColumnRenamed("node", "vis_code")
    return G.depicts_of(table(spark, d, "frames")).join(F.broadcast(c), "vis_code").select("frame_id", "ancestor", "hops").distinct()  # 25 parts


@query(f"WITH {FRAMES} SELECT frame_id, imo, uciqe FROM f WHERE {FOUND} ORDER BY frame_id LIMIT 300")
def q_graph_base_top300(spark: SparkSession, d: str) -> DataFrame:
    return G.base_frames(table(spark, d, "frames"), OPTS).select("frame_id", "imo", "uciqe")


@query(f"""WITH {FRAMES}, {EDGES}, b AS (SELECT * FROM f WHERE uciqe >= 4 AND NOT isnan(uciqe) ORDER BY frame_id LIMIT 300), dep AS ({DEP}), u AS (SELECT src, dst, visual, distance FROM e UNION ALL SELECT dst, src, visual, distance FROM e)
SELECT DISTINCT * FROM (
SELECT 'node' AS kind, 'im_' || frame_id AS src, imo AS dst FROM b UNION ALL SELECT 'in_mosaic', 'im_' || frame_id, 'm_' || mosaic_id FROM b JOIN ({IN_MOSAIC}) USING (frame_id)
UNION ALL SELECT 'similar_to' AS kind, 'im_' || src AS src, 'im_' || dst AS dst FROM u WHERE NOT visual AND distance < 1.5 AND NOT isnan(distance) AND src IN (SELECT frame_id FROM b)
UNION ALL SELECT 'visually_similar_to', 'im_' || src, 'im_' || dst FROM u WHERE visual AND distance < 10 AND NOT isnan(distance) AND src IN (SELECT frame_id FROM b)
UNION ALL SELECT 'in_inspection', 'im_' || frame_id, 'in_' || inspection_id FROM b
UNION ALL SELECT 'in_cluster', 'im_' || frame_id, 'c_' || cluster_id FROM in_cluster JOIN (SELECT DISTINCT cluster_id FROM clusters WHERE number <> -1) USING (cluster_id) WHERE frame_id IN (SELECT frame_id FROM b)
UNION ALL SELECT 'shows_part', 'im_' || frame_id, 'p_s_' || imo || '_' || vis_code FROM dep JOIN b USING (frame_id)
UNION ALL SELECT 'part_of_ship', 'p_s_' || imo || '_' || vis_code, 's_' || imo FROM dep JOIN b USING (frame_id)) WHERE src IS NOT NULL AND dst IS NOT NULL""")
def q_graph_view(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.createDataFrame([(a,) for a, _ in PARTS], "vis_code string")
    f = table(spark, d, "frames").select("frame_id", "inspection_id", "imo", "uciqe", *LABELS, *[f"{x}_{m}" for x in DEPICTS for m in ("segmentation", "classification")])
    v = G.view(f, similar(spark, d), table(spark, d, "in_cluster"), table(spark, d, "clusters"), _in_mosaic(spark, d), None, parts, FilterOptions(mosaics=True))
    out = v.pop("nodes").select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.get_json_object("data", "$.imo").alias("dst"))
    for kind, e in v.items():
        out = out.unionByName(e.select(F.lit(kind).alias("kind"), "src", "dst"))
    return out.filter("src is not null and dst is not null")


# aggregates


@query(f"WITH {FRAMES}, {INSPECTIONS} SELECT i.imo, {', '.join(SEEN.format(x) for x in DEFECTS)} FROM f JOIN i USING (inspection_id) WHERE uciqe >= 4 AND NOT isnan(uciqe) GROUP BY 1")
def q_table_by_ship(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "inspection_id", "uciqe", *DEFECTS).filter(findings(FilterOptions()))
    return A.defect_table(f.join(inspections(spark, d).select("inspection_id", "imo"), "inspection_id"), ["imo"])


@query(f"WITH {FRAMES}, dep AS ({DEP}) SELECT vis_code, {', '.join(SEEN.format(x) for x in DEFECTS)} FROM f JOIN (SELECT DISTINCT frame_id, vis_code FROM dep) USING (frame_id) GROUP BY 1")
def q_table_by_part(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, *DEFECTS, *DEPICTS)
    return A.by_part(f, _shown(f))


def _shown(f: DataFrame) -> DataFrame:
    """What frames depict, where only the parts matter."""
    return G.depicts_of(f.withColumns({f"{x}_{m}": F.lit(None).cast("double") for x in DEPICTS for m in ("segmentation", "classification")}))


_PART_NAMES = {code: ("hull" if x in ("anode", "bilge_keel") else x) for x, code in DEPICTS.items()}


@query(f"WITH {FRAMES}, dep AS ({DEP}), p(vis_code, name) AS (VALUES {', '.join(f'{x!r}' for x in _PART_NAMES.items())}) SELECT name, {', '.join(SEEN.format(x) for x in DEFECTS)} FROM f JOIN (SELECT DISTINCT frame_id, vis_code FROM dep) USING (frame_id) JOIN p USING (vis_code) GROUP BY 1")
def q_table_by_part_name(spark: SparkSession, d: str) -> DataFrame:
    """By the parts' names, over all ships and all parts of a name."""
    f = frames(spark, d, *DEFECTS, *DEPICTS)
    return A.by_part(f, _shown(f), spark.createDataFrame(list(_PART_NAMES.items()), "vis_code string, name string"))


@query(f"WITH {FRAMES}, {INSPECTIONS}, s AS (SELECT DISTINCT imo, [{', '.join(repr(n) for n in NAMES)}][CAST(('0x' || substr(md5(imo), 1, 8))::BIGINT % {len(NAMES)} AS INT) + 1] AS name FROM inspections WHERE imo IS NOT NULL) SELECT name, s.imo, {', '.join(SEEN.format(x) for x in DEFECTS)} FROM f JOIN (SELECT DISTINCT inspection_id, imo FROM i) i USING (inspection_id) JOIN s ON s.imo = i.imo WHERE uciqe >= 4 AND NOT isnan(uciqe) GROUP BY 1, 2")
def q_table_by_ship_name(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "inspection_id", "uciqe", *DEFECTS).filter(findings(FilterOptions()))
    return A.by_ship(f, inspections(spark, d), _ships(spark, d))


@query(f"WITH {FRAMES}, {INSPECTIONS} SELECT inspection_id, i.imo, date, {SHIP_HEADING} AS ship_heading, CAST((({BIN}) % 360 + 360) % 360 AS INT) AS heading, count(*) AS count FROM f JOIN i USING (inspection_id) WHERE heading IS NOT NULL AND NOT isnan(heading) AND NOT isinf(heading) GROUP BY ALL")
def q_heading_hist(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "inspection_id", "heading").filter("abs(heading) <> double('Infinity')")
    return A.heading_histogram(f, inspections(spark, d))


@query(f"WITH {FRAMES}, {INSPECTIONS} SELECT inspection_id, i.imo, date, {SHIP_HEADING} AS ship_heading, CAST({BIN} - trunc(({BIN}) / 360) * 360 AS INT) AS heading, count(*) AS count FROM f JOIN i USING (inspection_id) WHERE heading IS NOT NULL AND NOT isnan(heading) AND NOT isinf(heading) GROUP BY ALL")
def q_heading_hist_faithful(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "inspection_id", "heading").filter("abs(heading) <> double('Infinity')")
    return A.heading_histogram(f, inspections(spark, d), faithful=True)


@query(f"WITH {FRAMES}, {INSPECTIONS} SELECT DISTINCT inspection_id, CAST((({BIN}) % 360 + 360) % 360 AS INT) AS heading, thumbnail AS path, uciqe FROM f JOIN i USING (inspection_id) WHERE heading IS NOT NULL AND NOT isnan(heading) AND NOT isinf(heading) AND {FOUND}")
def q_frames_angle(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "inspection_id", "heading", "thumbnail", "uciqe", *OPTS.defects, *OPTS.parts)
    return A.sector_frames(f.filter("abs(heading) <> double('Infinity')"), inspections(spark, d), OPTS)


@query(f"WITH {FRAMES}, {INSPECTIONS}, m AS ({IN_MOSAIC}) SELECT DISTINCT inspection_id, CAST((({BIN}) % 360 + 360) % 360 AS INT) AS heading, coalesce(mosaic_id, thumbnail) AS path, uciqe FROM f JOIN i USING (inspection_id) LEFT JOIN m USING (frame_id) WHERE heading IS NOT NULL AND NOT isnan(heading) AND NOT isinf(heading) AND {FOUND}")
def q_frames_angle_mosaics(spark: SparkSession, d: str) -> DataFrame:
    """The mosaics that frames are in, and the frames that are in none."""
    f = frames(spark, d, "inspection_id", "heading", "thumbnail", "uciqe", *OPTS.defects, *OPTS.parts)
    return A.sector_frames(f.filter("abs(heading) <> double('Infinity')"), inspections(spark, d), replace(OPTS, mosaics=True), _in_mosaic(spark, d))


@query(f"WITH {FRAMES}, {INSPECTIONS} SELECT thumbnail AS path, uciqe FROM (SELECT DISTINCT inspection_id, CAST((({BIN}) % 360 + 360) % 360 AS INT) AS heading, thumbnail, uciqe FROM f JOIN i USING (inspection_id) WHERE heading IS NOT NULL AND NOT isnan(heading) AND NOT isinf(heading) AND uciqe >= 4 AND NOT isnan(uciqe)) WHERE heading = 330 AND inspection_id = {CHOSEN[0]}")
def q_sector_of_one(spark: SparkSession, d: str) -> DataFrame:
    """The drill-down of one sector of one inspection, best first."""
    f = table(spark, d, "frames").select("frame_id", "inspection_id", "heading", "thumbnail", "uciqe").filter("abs(heading) <> double('Infinity')")
    return A.frames_of_sector(f, inspections(spark, d), CHOSEN[0], 330, FilterOptions())


@query(f"WITH {FRAMES} SELECT cluster_id, thumbnail AS path, CASE WHEN isnan(uciqe) THEN NULL ELSE uciqe END AS uciqe, framenumber FROM f JOIN (SELECT DISTINCT * FROM in_cluster) USING (frame_id)")
def q_frames_cluster(spark: SparkSession, d: str) -> DataFrame:
    return A.cluster_frames(frames(spark, d, "thumbnail", "uciqe", "framenumber"), table(spark, d, "in_cluster"))


_WORDS = "trim(concat_ws(' ', " + ", ".join(f"CASE WHEN {x} > size // 3 THEN '{x}' END" for x in LABELS) + "))"


@query(f"""WITH {FRAMES}, c AS (SELECT DISTINCT cluster_id, inspection_id, number AS cluster FROM clusters WHERE number <> -1), m AS (SELECT c.inspection_id, c.cluster, f.* EXCLUDE (inspection_id) FROM (SELECT DISTINCT * FROM in_cluster) JOIN c USING (cluster_id) JOIN f USING (frame_id)),
g AS (SELECT inspection_id, cluster, count(*) AS size, min(framenumber) AS first_frame, {', '.join(SEEN.format(x) for x in LABELS)} FROM m GROUP BY 1, 2),
k AS (SELECT inspection_id, cluster, thumbnail, row_number() OVER (PARTITION BY inspection_id, cluster ORDER BY uciqe DESC, framenumber DESC NULLS LAST, frame_id DESC) AS n FROM m WHERE uciqe >= 0 AND NOT isnan(uciqe))
SELECT g.inspection_id, g.cluster, size, first_frame, coalesce(k.thumbnail, '') AS key_frame, {_WORDS} AS keywords FROM g LEFT JOIN k ON k.inspection_id = g.inspection_id AND k.cluster = g.cluster AND n = 1""")
def q_cluster_table(spark: SparkSession, d: str) -> DataFrame:
    return A.cluster_table(frames(spark, d, "inspection_id", "framenumber", "uciqe", "thumbnail", *LABELS), table(spark, d, "in_cluster"), table(spark, d, "clusters"))


@query(f"WITH {FRAMES} SELECT frame_id, cluster_id, round(avg(CASE WHEN isnan(uciqe) THEN NULL ELSE uciqe END) OVER (PARTITION BY cluster_id), 6) AS avg_quality FROM (SELECT DISTINCT * FROM in_cluster) JOIN f USING (frame_id)")
def q_mosaic_quality(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "in_cluster").distinct().join(frames(spark, d, "uciqe").withColumn("uciqe", F.expr("if(isnan(uciqe), null, uciqe)")), "frame_id")
    return G.member_quality(m, "cluster_id", "uciqe").select("frame_id", "cluster_id", F.round("avg_quality", 6).alias("avg_quality"))


@query(f"WITH {FRAMES}, v AS (SELECT 'uciqe' AS field, uciqe AS v, 0.5 AS w FROM f UNION ALL SELECT 'depth', depth, 2.0 FROM f) SELECT field, CAST(floor(v / w) * w AS DOUBLE) AS bin, count(*) AS count FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1, 2")
def q_hist_values(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "uciqe", "depth")
    h = lambda c, w: A.value_histogram(f, c, w).select(F.lit(c).alias("field"), "bin", "count")
    return h("uciqe", 0.5).unionByName(h("depth", 2.0))


@query(f"WITH {FRAMES}, {EDGES}, x AS (SELECT frame_id FROM f WHERE uciqe >= 0 AND NOT isnan(uciqe)), u AS (SELECT src, visual, distance FROM e UNION ALL SELECT dst, visual, distance FROM e) SELECT visual, count(*) AS edges, round(sum(distance), 4) AS total FROM u JOIN x ON src = frame_id WHERE visual IS NOT NULL AND (distance IS NULL OR NOT isnan(distance)) GROUP BY 1")
def q_hist_distances(spark: SparkSession, d: str) -> DataFrame:
    h = A.histogram_values(frames(spark, d, "uciqe", "depth"), similar(spark, d).filter("distance is null or not isnan(distance)"), FilterOptions())
    both = h["similar"].withColumn("visual", F.lit(False)).unionByName(h["visually_similar"].withColumn("visual", F.lit(True)))
    return both.groupBy("visual").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("distance"), 4).alias("total"))


@query(f"WITH {FRAMES} SELECT frame_id, round(least(CASE WHEN h < 0.05 THEN 0 ELSE g / h END, 1) * 100, 6) AS growth FROM (SELECT frame_id, coalesce(marine_growth_segmentation, 0) AS g, coalesce(bilge_keel_segmentation, 0) AS h FROM f)")
def q_growth_ratio(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d, "marine_growth_segmentation", "bilge_keel_segmentation").select("frame_id", F.round(S.growth_ratio("marine_growth_segmentation", "bilge_keel_segmentation"), 6).alias("growth"))


@query(f"WITH {FRAMES}, v AS (SELECT imo, CASE WHEN isnan(depth) OR isinf(depth) THEN NULL ELSE depth END AS v FROM f) SELECT imo, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS stdev, round(var_samp(v), 5) AS variance, count(v) AS samples FROM v GROUP BY 1")
def q_summary_stats(spark: SparkSession, d: str) -> DataFrame:
    s = A.summary(frames(spark, d, "imo", "depth").withColumn("depth", F.expr("if(abs(depth) = double('Infinity'), null, depth)")), ["imo"], "depth")
    return s.select("imo", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")], F.round("variance", 5).alias("variance"), "samples")


@query(f"WITH {FRAMES}, m AS ({IN_MOSAIC}), p AS (SELECT mosaic_id, round(sum(CASE WHEN isnan(marine_growth_segmentation) THEN NULL ELSE marine_growth_segmentation END), 4) AS g, round(sum(CASE WHEN isnan(bilge_keel_segmentation) THEN NULL ELSE bilge_keel_segmentation END), 4) AS h FROM f JOIN m USING (frame_id) GROUP BY 1), c AS (SELECT DISTINCT mosaic_id FROM m JOIN f USING (frame_id) WHERE uciqe >= 0 AND NOT isnan(uciqe)) SELECT CAST(floor(v / 5.0) * 5.0 AS DOUBLE) AS bin, count(*) AS count FROM (SELECT DISTINCT mosaic_id, least(CASE WHEN coalesce(h, 0) < 0.05 THEN 0 ELSE coalesce(g, 0) / h END, 1) * 100 AS v FROM p JOIN c USING (mosaic_id)) GROUP BY 1")
def q_hist_growth(spark: SparkSession, d: str) -> DataFrame:
    """The fifth histogram: how far the hull is grown over, each mosaic once."""
    h = A.histogram_values(frames(spark, d, "uciqe", "depth"), similar(spark, d), FilterOptions(), _in_mosaic(spark, d), _mosaics(spark, d))
    return A.value_histogram(h["growth"], "growth", 5.0)


@query("SELECT max(number) + 1 AS clusters, inspection_id FROM clusters GROUP BY inspection_id")
def q_cluster_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clusters").groupBy("inspection_id").agg((F.max("number") + 1).alias("clusters"))


@query("SELECT frame_id, CAST(pos - 1 AS INT) AS pos, tel[pos] AS value FROM (SELECT frame_id, tel, unnest(generate_series(1, len(tel))) AS pos FROM (SELECT DISTINCT frame_id, tel FROM features WHERE tel IS NOT NULL))")
def q_unwind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features").select("frame_id", "tel").distinct().select("frame_id", F.posexplode("tel").alias("pos", "value"))


# sinks


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 12 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_nationkey >= 12")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return store.upsert(c.filter("c_nationkey < 12").select("c_custkey", "c_acctbal"), c.select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer")
def q_property_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return store.upsert(c.select("c_custkey", "c_acctbal"), c.filter("c_nationkey >= 12").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")), ["c_custkey"], update=True)


@query("""WITH g AS (SELECT DISTINCT inspection_id FROM inspections WHERE file IS NULL), l AS (SELECT DISTINCT frame_id FROM frames JOIN g USING (inspection_id))
SELECT 'inspections' AS tab, count(*) AS n FROM inspections WHERE inspection_id NOT IN (FROM g) UNION ALL SELECT 'frames', count(*) FROM frames WHERE inspection_id IS NULL OR inspection_id NOT IN (FROM g)
UNION ALL SELECT 'clusters', count(*) FROM clusters WHERE inspection_id IS NULL OR inspection_id NOT IN (FROM g) UNION ALL SELECT 'in_cluster', count(*) FROM in_cluster WHERE frame_id IS NULL OR frame_id NOT IN (FROM l)
UNION ALL SELECT 'similar', count(*) FROM similar_frames WHERE (src IS NULL OR src NOT IN (FROM l)) AND (dst IS NULL OR dst NOT IN (FROM l))""")
def q_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("inspections", "frames", "clusters", "in_cluster")} | {"similar": table(spark, d, "similar_frames")}
    left = store.delete_inspections(t, t["inspections"].filter("file is null").select("inspection_id").distinct())
    out = None
    for n, x in left.items():
        c = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tab"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query(f"""WITH g AS (SELECT DISTINCT cluster_id FROM in_cluster WHERE frame_id IN (SELECT frame_id FROM frames WHERE inspection_id IN {CHOSEN}) AND cluster_id IS NOT NULL)
SELECT 'similar' AS tab, count(*) AS n FROM similar_frames WHERE src IS NULL OR src NOT IN (SELECT frame_id FROM frames WHERE inspection_id IN {CHOSEN}) UNION ALL SELECT 'clusters', count(*) FROM clusters WHERE cluster_id IS NULL OR cluster_id NOT IN (FROM g)
UNION ALL SELECT 'in_cluster', count(*) FROM in_cluster WHERE cluster_id IS NULL OR cluster_id NOT IN (FROM g)""")
def q_clear_similarities(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("frames", "clusters", "in_cluster")} | {"similar": table(spark, d, "similar_frames")}
    left = store.delete_context(t, CHOSEN)
    count = lambda n: left[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tab"), "n")
    return count("similar").unionByName(count("clusters")).unionByName(count("in_cluster"))


@query("SELECT DISTINCT frame_id FROM frames WHERE frame_id NOT IN (SELECT frame_id FROM features WHERE frame_id IS NOT NULL)")
def q_missing_features(spark: SparkSession, d: str) -> DataFrame:
    """The frames whose vectors are still to be computed."""
    return store.missing(table(spark, d, "frames").select("frame_id"), table(spark, d, "features"), ["frame_id"])


@query("SELECT DISTINCT cluster_id, number, inspection_id, number || '=' || inspection_id AS row_id FROM clusters WHERE number IS NOT NULL AND inspection_id IS NOT NULL")
def q_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """Row ids, built and taken apart again."""
    c = table(spark, d, "clusters").filter("number is not null and inspection_id is not null").select("cluster_id", S.row_id("number", "inspection_id").alias("row_id")).distinct()
    c = c.withColumn("p", S.split_row_id("row_id"))
    return c.select("cluster_id", F.col("p.cluster").alias("number"), F.col("p.inspection").alias("inspection_id"), "row_id")


@query("SELECT event_id, (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' AS length FROM (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) AS s FROM events)")
def q_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.duration(F.floor(F.abs("value") * 100)).alias("length"))


@query(f"WITH {FRAMES} SELECT frame_id, uciqe FROM f WHERE {FOUND} AND inspection_id IN {CHOSEN}")
def q_findings_of_inspections(spark: SparkSession, d: str) -> DataFrame:
    o = replace(OPTS, inspections=CHOSEN)
    return of_inspections(table(spark, d, "frames"), o).filter(findings(o)).select("frame_id", "uciqe").distinct()


@query("SELECT DISTINCT frame_id, cluster_id FROM in_cluster WHERE cluster_id IS NOT NULL UNION SELECT DISTINCT frame_id, 'c' || inspection_id || '.-1' FROM features")
def q_attach(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "features").select("frame_id", F.concat(F.lit("c"), F.col("inspection_id").cast("string"), F.lit(".-1")).alias("cluster_id"))
    return store.attach(table(spark, d, "in_cluster").filter("cluster_id is not null"), new)


@query("SELECT c_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey")
def q_checked_children(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return store.checked(o, c, "c_custkey")


# scalars


@query("SELECT c_custkey, CAST((7984002041 + 46663 * list_sum(list_transform(generate_series(1, 32), lambda i: ascii(substr(md5(c_name), i, 1))))) % 1000000 AS BIGINT) AS detid FROM customer")
def q_detid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.detid("c_name").alias("detid"))


@query(f"SELECT c_custkey, [{', '.join(repr(n) for n in NAMES)}][CAST(('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % {len(NAMES)} AS INT) + 1] AS name FROM customer")
def q_pseudonym(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.pseudonym("c_custkey", NAMES).alias("name"))


_FINITE = "CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0.0 ELSE {0} END"


@query(f"WITH {FRAMES} SELECT frame_id, " + ", ".join(f"CAST({_FINITE.format(c)} AS DOUBLE) AS {c}" for c in ("depth", "heading", "rangefinder")) + " FROM f")
def q_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d, "depth", "heading", "rangefinder").select("frame_id", *[S.sanitize(c).alias(c) for c in ("depth", "heading", "rangefinder")])


@query(f"WITH {FRAMES}, s AS (SELECT frame_id, {', '.join(f'{_FINITE.format(c)} AS {c}' for c in ('depth', 'heading', 'camera_tilt', 'framenumber'))} FROM f) SELECT frame_id, round(depth, 6) AS t0, round(sin(radians(heading)), 6) AS t1, round(cos(radians(heading)), 6) AS t2, round(camera_tilt, 6) AS t3, round(framenumber, 6) AS t4 FROM s")
def q_trig_features(spark: SparkSession, d: str) -> DataFrame:
    f = X.telemetry_vector(frames(spark, d, "depth", "heading", "camera_tilt", "framenumber"))
    return f.select("frame_id", *[F.round(F.col("tel")[i], 6).alias(f"t{i}") for i in range(5)])


@query("SELECT event_id, round(1 / (1 + exp(-(value / 50 - 2))), 6) AS p FROM events")
def q_logistic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(S.logistic(F.col("value") / 50 - 2), 6).alias("p"))


@query("SELECT vec_id, CAST(i AS INT) AS place, round(exp(x[i + 1] - list_max(x)) / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(len(embedding))) AS i FROM embeddings)")
def q_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.posexplode(S.softmax("x")).alias("place", "p")).withColumn("p", F.round("p", 6))


def _box(v: str, k: int) -> str:
    return ", ".join(f"abs({v}[{4 * k + i + 1}]::DOUBLE) AS {c}{k}" for i, c in enumerate("xywh"))


@query(f"WITH b AS (SELECT vec_id, {_box('embedding', 0)}, {_box('embedding', 1)} FROM embeddings), o AS (SELECT *, greatest(least(x0 + w0, x1 + w1) - greatest(x0, x1), 0) * greatest(least(y0 + h0, y1 + h1) - greatest(y0, y1), 0) AS n FROM b) SELECT vec_id, round(n / (w0 * h0 + w1 * h1 - n), 6) AS iou, CAST(ceil(round(x0, 8) * 640) AS BIGINT) AS px FROM o")
def q_iou(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    box = lambda k: {c: F.abs(F.col("e")[4 * k + i]) for i, c in enumerate("xywh")}
    return e.select("vec_id", F.round(S.iou(box(0), box(1)), 6).alias("iou"), S.pixel(F.abs(F.col("e")[0]), 640).alias("px"))


# vision


@query(f"WITH {FRAMES} SELECT frame_id, " + ", ".join(f"(CASE WHEN {x}_classification > 0.5 AND NOT isnan({x}_classification) THEN 1 ELSE 0 END + CASE WHEN {x}_segmentation > 0.01 AND NOT isnan({x}_segmentation) THEN 1 ELSE 0 END)::INT AS {x}" for x in LABELS) + " FROM f")
def q_score_fusion(spark: SparkSession, d: str) -> DataFrame:
    return V.fuse(frames(spark, d)).select("frame_id", *LABELS)


@query("SELECT vec_id, round(len(list_filter(x, lambda v: v > 0.1)) / len(x), 6) AS coverage FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.round(V.coverage("x", 0.1), 6).alias("coverage"))


@query("SELECT vec_id, round(coalesce(len(list_filter(x, lambda v: v > 0.05)) * 100.0 / nullif(len(list_filter(x, lambda v: v > 0)), 0), 0), 6) AS overlap, round(coalesce(len(list_filter(x, lambda v: v > 0.05)) * 100.0 / nullif(len(list_filter(x, lambda v: v > -0.05)), 0), 0), 6) AS share FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def q_mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    over = lambda t: F.transform("x", lambda v: v > t)
    return e.select("vec_id", F.round(V.overlap(over(0.0), over(0.05)), 6).alias("overlap"), F.round(V.label_share(over(0.05), over(-0.05)), 6).alias("share"))


_IOU = "(greatest(least(q.x + q.w, r.x + r.w) - greatest(q.x, r.x), 0) * greatest(least(q.y + q.h, r.y + r.h) - greatest(q.y, r.y), 0))"


@query(f"""WITH RECURSIVE e AS (SELECT label || '.' || (vec_id // 50) AS image_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT image_id, abs(e[1]) AS x, abs(e[2]) AS y, abs(e[3]) AS w, abs(e[4]) AS h, list_transform(e[5:8], lambda v: least(abs(v) * 3, 1.0)) AS p, row_number() OVER (PARTITION BY image_id ORDER BY abs(e[1]), abs(e[2]), abs(e[3]), abs(e[4])) - 1 AS box FROM e),
c AS (SELECT image_id, box, x, y, w, h, k AS class, p[k + 1] AS prob FROM b, range(4) t(k) WHERE p[k + 1] >= 0.15), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, class ORDER BY prob DESC, box) AS n FROM c),
g AS (SELECT image_id, class, 0::BIGINT AS n, []::STRUCT(box BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, prob DOUBLE)[] AS kept FROM (SELECT DISTINCT image_id, class FROM r) UNION ALL
SELECT g.image_id, g.class, g.n + 1, CASE WHEN len(list_filter(g.kept, lambda q: {_IOU} > 0.45 * (q.w * q.h + r.w * r.h - {_IOU}))) = 0 THEN list_append(g.kept, struct_pack(box := r.box, x := r.x, y := r.y, w := r.w, h := r.h, prob := r.prob)) ELSE g.kept END FROM g JOIN r ON g.image_id = r.image_id AND g.class = r.class AND r.n = g.n + 1),
f AS (SELECT image_id, class, unnest(k) AS k FROM (SELECT image_id, class, arg_max(kept, n) AS k FROM g GROUP BY 1, 2)), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k.prob DESC, k.box, class) AS rn FROM f)
SELECT image_id, CAST(k.box AS INT) AS box, CAST(class AS INT) AS class, k.prob AS probability, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM o WHERE rn <= 20""")
def q_detections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from the vectors' elements, suppressed within each class of an image."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    boxes = e.select(F.concat_ws(".", "label", F.expr("vec_id div 50")).alias("image_id"), *[F.abs(F.col("e")[i]).alias(c) for i, c in enumerate("xywh")], F.transform(F.slice("e", 5, 4), lambda v: F.least(F.abs(v) * 3, F.lit(1.0))).alias("class_probs"))
    return V.detections(boxes)


_PIXELS = "c AS (SELECT label, list(e ORDER BY vec_id, i) AS c, list(l ORDER BY vec_id, i) AS l FROM (SELECT label, vec_id, i, abs(x[i]) AS e, abs(x[65 - i]) AS l FROM (SELECT label, vec_id, embedding::DOUBLE[] AS x, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY 1), s AS (SELECT *, greatest(1, CAST(floor(0.01 * len(l) + 0.5) AS BIGINT)) AS n FROM c)"


@query(f"WITH {_PIXELS} SELECT label, round(0.468 * list_stddev_pop(c) + 0.2745 * (list_avg(list_reverse_sort(l)[1:len(l):n]) - list_avg(list_sort(l)[1:len(l):n])) + 0.2576 * list_avg(list_transform(list_zip(c, l), lambda p: CASE WHEN p[1] = 0 OR p[2] = 0 THEN 0 ELSE p[1] / p[2] END)), 5) AS uciqe FROM s")
def q_uciqe(spark: SparkSession, d: str) -> DataFrame:
    """The quality of images whose pixels are the elements of a label's vectors."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("x"))
    e = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x", F.reverse("x").alias("l")))).alias("p"))
    e = e.select("label", F.flatten(F.transform("p", lambda s: s["x"])).alias("chroma"), F.flatten(F.transform("p", lambda s: s["l"])).alias("lightness"))
    return V.with_uciqe(e, "chroma", "lightness").select("label", F.round("uciqe", 5).alias("uciqe"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(64)) AS k FROM embeddings), f AS (SELECT vec_id, k, x[(k % 8) * 8 + k // 8 + 1] > 0.02 AS f FROM p), n AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY vec_id ORDER BY k) THEN 1 ELSE 0 END AS s FROM f),
r AS (SELECT *, sum(s) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM n), c AS (SELECT vec_id, run, any_value(f) AS f, count(*) AS n FROM r GROUP BY 1, 2) SELECT vec_id, CASE WHEN bool_or(f AND run = 1) THEN '0 ' ELSE '' END || string_agg(n::VARCHAR, ' ' ORDER BY run) AS counts FROM c GROUP BY 1""")
def q_mask_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run lengths of masks of 8 by 8."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") > 0.02).alias("mask"))
    return V.with_run_lengths(e, "mask", 8).select("vec_id", F.array_join("counts", " ").alias("counts"))


@query("SELECT * FROM (SELECT DISTINCT src, dst, visual, distance FROM similar_frames WHERE distance IS NOT NULL AND NOT isnan(distance)) QUALIFY row_number() OVER (PARTITION BY src, visual ORDER BY distance, dst) <= 2")
def q_best_matches(spark: SparkSession, d: str) -> DataFrame:
    e = similar(spark, d).select("src", "dst", "visual", "distance").filter("distance is not null and not isnan(distance)")
    return A.top_rows(e, ["src", "visual"], ["distance", "dst"], 2)


_M = [f"CASE WHEN {k} IN (0, 4, 8) THEN 1 ELSE 0 END + 0.05 * embedding[{k + 1}]::DOUBLE" for k in range(9)]


@query(f"""WITH RECURSIVE e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, [{', '.join(_M)}] AS m FROM embeddings), h AS (SELECT label, vec_id, n, m AS h FROM e WHERE n = 1 UNION ALL
SELECT e.label, e.vec_id, e.n, [{', '.join(' + '.join(f'h.h[{3 * i + k + 1}] * e.m[{3 * k + j + 1}]' for k in range(3)) for i in range(3) for j in range(3))}] FROM h JOIN e ON h.label = e.label AND e.n = h.n + 1) SELECT label, vec_id, {', '.join(f'round(h[{k + 1}], 5) + 0.0 AS h{k}' for k in range(9))} FROM h""")
def q_homographies(spark: SparkSession, d: str) -> DataFrame:
    """Running products of each label's matrices."""
    m = table(spark, d, "embeddings").select("label", "vec_id", F.array(*[F.lit(float(k in (0, 4, 8))) + 0.05 * F.col("embedding")[k].cast("double") for k in range(9)]).alias("m"))
    return M.compose(m, "label", "vec_id", "m").select("label", "vec_id", *[(F.round(F.col("homography")[k], 5) + 0.0).alias(f"h{k}") for k in range(9)])


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS m FROM embeddings) SELECT vec_id, {', '.join('round(' + ' + '.join(f'm[{3 * (n // 3) + k + 1}] * m[{3 * k + n % 3 + 10}]' for k in range(3)) + f', 6) + 0.0 AS p{n}' for n in range(9))} FROM e")
def q_matrix_product(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("p", S.matrix_product(F.slice("e", 1, 9), F.slice("e", 10, 9)))
    return e.select("vec_id", *[(F.round(F.col("p")[n], 6) + 0.0).alias(f"p{n}") for n in range(9)])


# series


def _telemetry(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', time)"))
    return T.one_per_instant(t, "inspection_id", "us", ["depth", "heading", "pitch", "roll", "rangefinder"])


_INSTANT = "t AS (SELECT * FROM (SELECT inspection_id, epoch_us(time) AS us, CASE WHEN isnan(depth) THEN NULL ELSE depth END AS depth, CASE WHEN isnan(heading) THEN NULL ELSE heading END AS heading, row_number() OVER (PARTITION BY inspection_id, time ORDER BY depth NULLS FIRST, heading NULLS FIRST, pitch NULLS FIRST, roll NULLS FIRST, rangefinder NULLS FIRST) AS rn FROM telemetry WHERE inspection_id IS NOT NULL AND time IS NOT NULL) WHERE rn = 1)"
_UNWRAPPED = f"{_INSTANT}, h AS (SELECT inspection_id, us, heading, lag(heading) OVER w AS last, first_value(heading) OVER w AS f FROM t WHERE heading IS NOT NULL WINDOW w AS (PARTITION BY inspection_id ORDER BY us)), u AS (SELECT inspection_id, us, f + sum(coalesce(((heading - last + 180) % 360 + 360) % 360 - 180, 0)) OVER (PARTITION BY inspection_id ORDER BY us) AS x FROM h)"


@query(f"WITH {_INSTANT} SELECT inspection_id, us, depth, heading FROM t")
def q_one_per_instant(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.expr(f"if(isnan({c}), null, {c})").alias(c)
    return _telemetry(spark, d).select("inspection_id", "us", clean("depth"), clean("heading"))


@query(f"WITH {_UNWRAPPED} SELECT inspection_id, us, round(x, 4) AS unwrapped FROM u")
def q_unwrap(spark: SparkSession, d: str) -> DataFrame:
    return T.unwrap(_telemetry(spark, d), "inspection_id", "us", "heading").filter("unwrapped is not null").select("inspection_id", "us", F.round("unwrapped", 4).alias("unwrapped"))


def _filled(src: str, value: str, out: str) -> str:
    return f"{out} AS (SELECT k.inspection_id, k.k, CASE WHEN b.us IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (k.t - a.us) / (b.us - a.us) END AS v FROM k LEFT JOIN LATERAL (SELECT us, {value} AS v FROM {src} s WHERE s.inspection_id = k.inspection_id AND s.us <= k.t + 0.001 AND {value} IS NOT NULL ORDER BY us DESC LIMIT 1) a ON true LEFT JOIN LATERAL (SELECT us, {value} AS v FROM {src} s WHERE s.inspection_id = k.inspection_id AND s.us > k.t + 0.001 AND {value} IS NOT NULL ORDER BY us LIMIT 1) b ON true)"


@query(f"WITH {_UNWRAPPED}, b AS (SELECT inspection_id, min(us) AS lo, max(us) AS hi FROM t GROUP BY 1), k AS (SELECT inspection_id, unnest(generate_series(0, CASE WHEN hi > lo THEN 49 ELSE 49 END)) AS k, lo, hi FROM b), kk AS (SELECT inspection_id, k, lo + k * ((hi - lo) / 49) AS t FROM k), {_filled('t', 'depth', 'd').replace('FROM k ', 'FROM kk k ')}, {_filled('u', 'x', 'h2').replace('FROM k ', 'FROM kk k ')} SELECT d.inspection_id, d.k AS frame_index, round(d.v, 4) AS depth, round(sin(radians(h2.v)), 4) AS heading_sin FROM d JOIN h2 USING (inspection_id, k)")
def q_resample(spark: SparkSession, d: str) -> DataFrame:
    r = T.resample(_telemetry(spark, d), "inspection_id", "us", ["depth", "heading"], 50, ["heading"])
    return r.select("inspection_id", "frame_index", F.round("depth", 4).alias("depth"), F.round(F.sin(F.radians("heading")), 4).alias("heading_sin"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS flag FROM events), n AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS x FROM e),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n) SELECT user_id, CAST(run AS BIGINT) AS run, any_value(flag) AS flag, min(event_id) AS start, count(*) AS length FROM r GROUP BY user_id, run""")
def q_rle(spark: SparkSession, d: str) -> DataFrame:
    return T.flag_runs(table(spark, d, "events").withColumn("click", F.col("event_type") == "click"), "user_id", "event_id", "click")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("inspection_id"), F.col("event_id").alias("frame_index"), (F.col("event_type") != "error").alias("ok"), (F.col("value") / 100).alias("size_increase"))


_ISLANDS = """l AS (SELECT user_id AS i, event_id AS n, event_type <> 'error' AS ok, value / 100 AS s FROM events), b AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY i ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l),
m AS (SELECT i AS inspection_id, 'm' || i || '.' || min(n) FILTER (WHERE ok) AS mosaic_id, min(n) FILTER (WHERE ok) AS start_frame, max(n) AS end_frame, count(*) FILTER (WHERE ok) AS frames, arg_max(s, n) FILTER (WHERE ok) AS growth, bool_or(NOT ok) AS closed FROM b GROUP BY i, g),
k AS (SELECT * FROM m WHERE frames > 0 AND NOT (frames < 4 AND growth < 1.5))"""


@query(f"WITH {_ISLANDS} SELECT * FROM k")
def q_mosaic_segments(spark: SparkSession, d: str) -> DataFrame:
    return M.segments(_log(spark, d), least_frames=4)


@query(f"WITH {_ISLANDS} SELECT i AS inspection_id, n AS frame_index, mosaic_id FROM l JOIN k ON i = inspection_id AND n >= start_frame AND n <= CASE WHEN closed THEN end_frame - 1 ELSE end_frame END WHERE ok AND n % 30 = 0")
def q_mosaic_members(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return M.membership(log, M.segments(log, least_frames=4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS x FROM events), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS count FROM s GROUP BY user_id, k""")
def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "ts", "user_id", "5 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "count")


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS count FROM events GROUP BY 1, 2")
def q_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(table(spark, d, "events"), "ts", "event_type", "1 hour").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "count")


# vectors

_TEL = "v AS (SELECT frame_id, inspection_id, any_value(tel) AS tel FROM features WHERE tel IS NOT NULL GROUP BY 1, 2)"
_DIST = "sqrt(" + " + ".join(f"(a.tel[{i}] - b.tel[{i}]) * (a.tel[{i}] - b.tel[{i}])" for i in range(1, 6)) + ")"


@query(f"WITH {_TEL}, s AS (SELECT inspection_id, " + ", ".join(f"avg(tel[{i}]) AS m{i}, stddev_pop(tel[{i}]) AS d{i}" for i in range(1, 6)) + " FROM v GROUP BY 1) SELECT frame_id, " + ", ".join(f"round(CASE WHEN d{i} > 1e-12 THEN (tel[{i}] - m{i}) / d{i} ELSE 0 END, 5) AS z{i - 1}" for i in range(1, 6)) + " FROM v JOIN s USING (inspection_id)")
def q_standardise(spark: SparkSession, d: str) -> DataFrame:
    z = X.standardise(vectors(spark, d), "inspection_id", "tel", 5)
    return z.select("frame_id", *[F.round(F.col("scaled")[i], 5).alias(f"z{i}") for i in range(5)])


@query(f"WITH {_TEL}, p AS (SELECT a.frame_id AS src, b.frame_id AS dst, {_DIST} AS distance FROM v a JOIN v b ON a.inspection_id = b.inspection_id AND a.frame_id <> b.frame_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 9), dst) AS rank FROM p) SELECT src, dst, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4")
def q_knn(spark: SparkSession, d: str) -> DataFrame:
    return N.k_nearest(vectors(spark, d), id="frame_id", group="inspection_id", vector="tel").select("src", "dst", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH RECURSIVE {_TEL}, p AS (SELECT a.inspection_id AS i, a.frame_id AS x, b.frame_id AS y FROM v a JOIN v b ON a.inspection_id = b.inspection_id AND {_DIST} <= 61.4), c AS (SELECT i, x FROM p GROUP BY 1, 2 HAVING count(*) >= 5), cp AS (SELECT p.i, p.x, p.y FROM p JOIN c a ON p.x = a.x JOIN c b ON p.y = b.x),
r AS (SELECT x, y FROM cp UNION SELECT r.x, cp.y FROM r JOIN cp ON r.y = cp.x), l AS (SELECT c.i, c.x, min(r.y) AS label FROM c JOIN r ON r.x = c.x GROUP BY 1, 2), n AS (SELECT i, label, row_number() OVER (PARTITION BY i ORDER BY label) - 1 AS number FROM (SELECT DISTINCT i, label FROM l)), k AS (SELECT l.x, number FROM l JOIN n ON l.i = n.i AND l.label = n.label),
b AS (SELECT p.x, min(number) AS number FROM p JOIN k ON p.y = k.x GROUP BY 1) SELECT frame_id AS id, inspection_id AS "group", k.x IS NOT NULL AS core, CAST(coalesce(k.number, b.number, -1) AS INT) AS number FROM v LEFT JOIN k ON frame_id = k.x LEFT JOIN b ON frame_id = b.x""")
def q_dbscan(spark: SparkSession, d: str) -> DataFrame:
    return N.density_clusters(vectors(spark, d), id="frame_id", group="inspection_id", vector="tel", eps=61.4)


@query("""WITH e AS (SELECT label, row_number() OVER () AS r, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT label, r, unnest(x) AS v, unnest(range(64)) AS i FROM e)
SELECT a.label, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_pop(a.v, b.v), 6) + 0.0 AS covariance FROM u a JOIN u b ON a.r = b.r GROUP BY ALL""")
def q_pca(spark: SparkSession, d: str) -> DataFrame:
    """The covariances that all components together stand for."""
    c = X.components(table(spark, d, "embeddings"), "label", "embedding", 64)
    parts = c.select("label", F.explode(F.arrays_zip("variance", "axes")).alias("k")).select("label", "k.variance", F.posexplode("k.axes").alias("i", "x"), "k.axes")
    parts = parts.select("label", "i", (F.col("variance") * F.col("x")).alias("w"), F.posexplode("axes").alias("j", "y"))
    return parts.groupBy("label", "i", "j").agg((F.round(F.sum(F.col("w") * F.col("y")), 6) + 0.0).alias("covariance"))


@query("WITH a AS (SELECT label, list(x ORDER BY vec_id) AS axes FROM (SELECT *, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 3 GROUP BY 1) SELECT vec_id, CAST(k AS INT) AS k, round(list_dot_product(embedding::DOUBLE[], axes[k + 1]), 6) + 0.0 AS along FROM embeddings JOIN a USING (label), range(3) t(k) WHERE k < len(axes)")
def q_project(spark: SparkSession, d: str) -> DataFrame:
    """Vectors along three axes of their label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    axes = A.top_rows(e, ["label"], ["vec_id"], 3).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda s: s["x"]).alias("axes"))
    p = X.project(e, axes, "label", "x").select("vec_id", F.posexplode("reduced").alias("k", "along"))
    return p.select("vec_id", "k", (F.round("along", 6) + 0.0).alias("along"))


@query()
def q_reduced(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return X.project(e, X.components(e, "label", "embedding", 8), "label", "embedding").select("vec_id", "label", "reduced")


@query()
def q_contextualise(spark: SparkSession, d: str) -> DataFrame:
    """Similarity edges by standardised telemetry and by the image vectors' components, within inspections."""
    from tidemark.operators.contextualise import contextualise

    return contextualise(table(spark, d, "features"))["similar"]
