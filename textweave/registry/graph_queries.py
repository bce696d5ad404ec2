"""Queries: property graph and ball mapper."""

from __future__ import annotations

from pyspark.sql import functions as F

from textweave.operators import ballmapper as bm
from textweave.operators import graph as gr
from textweave.operators import linkage
from textweave.registry.frames import DOCS, KEYWORDED, documents, flat, keyworded, label_rows, query, table

KEY = "properties"


def _nodes(df):
    return df.select("id", "label", F.md5(flat()).alias(KEY))


def _edges(df):
    return df.select("source", "target", "label")


DOC_NODES = """SELECT id, 'document' AS label, md5('doc_cluster=' || lang || ';doc_lang=' || lang || ';doc_n_chars=' || n_chars || ';doc_source=' || source || ';name=' || name || ';text=' || left(text, 500)) AS properties FROM docs"""
KEYWORD_NODES = "SELECT DISTINCT 'keyword:' || keyword AS id, 'keyword' AS label, md5('') AS properties FROM keywords"
CLUSTER_NODES = "SELECT DISTINCT 'cluster:' || lang AS id, 'cluster' AS label, md5('') AS properties FROM docs"
ROW_NODES = "SELECT 'metadata:' || doc_id AS id, 'metadata' AS label, md5('quality=' || quality || ';toxic=' || toxic) AS properties FROM labels"
DOC_KEYWORD = "SELECT id AS source, 'keyword:' || keyword AS target, 'HAS_KEYWORD' AS label FROM keywords"
DOC_CLUSTER = "SELECT id AS source, 'cluster:' || lang AS target, 'BELONGS_TO_CLUSTER' AS label FROM docs"
DOC_ROW = "SELECT CAST(doc_id AS VARCHAR) AS source, 'metadata:' || doc_id AS target, 'HAS_METADATA' AS label FROM labels"
CLUSTER_KEYWORD = "SELECT DISTINCT 'cluster:' || lang AS source, 'keyword:' || keyword AS target, 'CLUSTER_HAS_KEYWORD' AS label FROM keywords JOIN docs USING (id)"
KEYWORD_ROW = "SELECT 'keyword:' || keyword AS source, 'metadata:' || doc_id AS target, 'KEYWORD_HAS_METADATA' AS label FROM keywords JOIN labels ON id = CAST(doc_id AS VARCHAR)"
CLUSTER_ROW = "SELECT 'cluster:' || lang AS source, 'metadata:' || doc_id AS target, 'CLUSTER_HAS_METADATA' AS label FROM docs JOIN labels ON num = doc_id"
NODES = f"nodes AS ({DOC_NODES} UNION ALL {KEYWORD_NODES} UNION ALL {CLUSTER_NODES} UNION ALL {ROW_NODES})"
EDGES = f"edges AS ({DOC_KEYWORD} UNION ALL {DOC_CLUSTER} UNION ALL {DOC_ROW} UNION ALL {CLUSTER_KEYWORD} UNION ALL {KEYWORD_ROW} UNION ALL {CLUSTER_ROW})"


def _graph(spark, d):
    return gr.build_graph(keyworded(spark, d), label_rows(spark, d), require_keywords=False)


@query("gr01_document_nodes", f"WITH {DOCS} {DOC_NODES}")
def document_nodes(spark, d):
    return _nodes(gr.document_nodes(keyworded(spark, d)))


@query("gr02_keyword_nodes", f"WITH {KEYWORDED} {KEYWORD_NODES}")
def keyword_nodes(spark, d):
    return _nodes(gr.keyword_nodes(keyworded(spark, d)))


@query("gr03_cluster_nodes", f"WITH {DOCS} {CLUSTER_NODES}")
def cluster_nodes(spark, d):
    return _nodes(gr.cluster_nodes(keyworded(spark, d)))


@query("gr04_metadata_nodes", ROW_NODES)
def metadata_nodes(spark, d):
    return _nodes(gr.metadata_nodes(label_rows(spark, d)))


@query("gr05_document_edges", f"WITH {KEYWORDED} {DOC_KEYWORD} UNION ALL {DOC_CLUSTER} UNION ALL {DOC_ROW}")
def document_edges(spark, d):
    docs = keyworded(spark, d)
    return _edges(gr.keyword_edges(docs).unionByName(gr.cluster_edges(docs)).unionByName(gr.metadata_edges(label_rows(spark, d))))


@query("gr06_cluster_keyword_edges", f"WITH {KEYWORDED} {CLUSTER_KEYWORD}")
def cluster_keyword_edges(spark, d):
    return _edges(gr.cluster_keyword_edges(keyworded(spark, d)))


@query("gr07_keyword_metadata_edges", f"WITH {KEYWORDED} {KEYWORD_ROW}")
def keyword_metadata_edges(spark, d):
    return _edges(gr.keyword_metadata_edges(keyworded(spark, d), label_rows(spark, d)))


@query("gr08_cluster_metadata_edges", f"WITH {DOCS} {CLUSTER_ROW}")
def cluster_metadata_edges(spark, d):
    return _edges(gr.cluster_metadata_edges(keyworded(spark, d), label_rows(spark, d)))


@query(
    "gr06_complete_edges",
    f"""WITH {KEYWORDED}, sizes AS (SELECT (SELECT count(DISTINCT lang) FROM docs) AS c, (SELECT count(DISTINCT keyword) FROM keywords) AS k, (SELECT count(DISTINCT doc_id) FROM labels) AS m)
SELECT 'CLUSTER_HAS_KEYWORD' AS label, 'cluster' AS source_label, 'keyword' AS target_label, c AS n_sources, k AS n_targets, c * k AS n_edges FROM sizes
UNION ALL SELECT 'KEYWORD_HAS_METADATA', 'keyword', 'metadata', k, m, k * m FROM sizes UNION ALL SELECT 'CLUSTER_HAS_METADATA', 'cluster', 'metadata', c, m, c * m FROM sizes""",
)
def complete_edges(spark, d):
    return gr.complete_edges(_graph(spark, d).nodes)


@query(
    "gr09_graph_counts",
    f"WITH {KEYWORDED}, {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM edges) AS num_edges, (SELECT count(*) FROM docs) AS num_documents, true AS has_keywords, true AS has_clusters, true AS has_metadata",
)
def graph_counts(spark, d):
    return gr.graph_counts(_graph(spark, d))


WEEK = "CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) || '/' || CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS VARCHAR)"
SUBGRAPHS = f"""{KEYWORDED}, {EDGES}, dated AS (SELECT id, {WEEK} AS period FROM docs WHERE ts IS NOT NULL),
outgoing AS (SELECT period, e.* FROM edges e JOIN dated d ON d.id = e.source),
members AS (SELECT period, id FROM dated UNION SELECT period, target FROM outgoing)"""


@query("gr10_subgraph_nodes", f"WITH {SUBGRAPHS} SELECT period, id FROM members")
def subgraph_nodes(spark, d):
    return gr.temporal_subgraphs(_graph(spark, d), documents(spark, d), "W")[0]


@query(
    "gr10_subgraph_edges",
    f"""WITH {SUBGRAPHS} SELECT period, source, target, label FROM outgoing
UNION ALL SELECT a.period, e.source, e.target, e.label FROM edges e JOIN members a ON a.id = e.source JOIN members b ON b.id = e.target AND a.period = b.period WHERE regexp_matches(e.source, '^(keyword|cluster):')""",
)
def subgraph_edges(spark, d):
    return gr.temporal_subgraphs(_graph(spark, d), documents(spark, d), "W")[1].select("period", "source", "target", "label")


LABEL_TIMES = f"""{DOCS}, timed AS (SELECT l.doc_id AS row_id, TIMESTAMP '2024-01-01' + to_minutes(CAST((l.doc_id * 101) % 43200 AS INTEGER)) AS ts FROM labels l),
links AS (SELECT d.id AS doc_id, t.row_id, (epoch_us(t.ts) - epoch_us(d.ts)) / 1e6 AS gap FROM docs d JOIN timed t ON t.ts BETWEEN d.ts - INTERVAL 1 HOUR AND d.ts + INTERVAL 1 HOUR)"""


@query("gr11_temporal_edges", f"WITH {LABEL_TIMES} SELECT doc_id AS source, 'metadata:' || row_id AS target, 'TEMPORAL_LINK' AS label, CAST(gap AS DOUBLE) AS time_gap, 'time_window' AS link_type FROM links")
def temporal_edges(spark, d):
    minutes = ((F.col("row_id") * 101) % 43200).cast("int")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    rows = label_rows(spark, d)
    links = linkage.link_by_time_window(documents(spark, d), rows.withColumn("ts", ts), "ts", 3600, 3600)
    out = gr.temporal_edges(_graph(spark, d), links, rows)
    value = lambda k: F.try_element_at(KEY, F.lit(k))
    return out.select("source", "target", "label", value("time_gap").cast("double").alias("time_gap"), value("link_type").alias("link_type"))


@query("gr12_filtered_nodes", f"WITH {KEYWORDED}, {NODES} SELECT id, label, properties FROM nodes WHERE label IN ('document', 'cluster')")
def filtered_nodes(spark, d):
    return _nodes(gr.filter_nodes(_graph(spark, d), ["document", "cluster", "unknown"]).nodes)


@query("gr12_filtered_edges", f"WITH {KEYWORDED} {DOC_CLUSTER}")
def filtered_edges(spark, d):
    return _edges(gr.filter_nodes(_graph(spark, d), ["document", "cluster"]).edges)


# -- ball mapper ---------------------------------------------------------------------------------------------------

RADIUS = 0.3
COVER = f"""scaled AS (
  SELECT c_custkey AS row_id, (c_nationkey - min(c_nationkey) OVER ()) / CAST(max(c_nationkey) OVER () - min(c_nationkey) OVER () AS DOUBLE) AS x1,
         (c_custkey - min(c_custkey) OVER ()) / CAST(max(c_custkey) OVER () - min(c_custkey) OVER () AS DOUBLE) AS x2,
         (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS y FROM customer),
pts AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS rn FROM scaled),
walk AS (
  SELECT 1 AS step, [{{'row_id': row_id, 'x1': x1, 'x2': x2}}] AS lms FROM pts WHERE rn = 1
  UNION ALL
  SELECT step + 1, list_append(lms, arg_min({{'row_id': row_id, 'x1': x1, 'x2': x2}}, rn)) FROM walk, pts
  WHERE len(list_filter(lms, lambda l: sqrt((l.x1 - x1) * (l.x1 - x1) + (l.x2 - x2) * (l.x2 - x2)) <= {RADIUS})) = 0 GROUP BY step, lms),
final AS (SELECT lms FROM walk ORDER BY step DESC LIMIT 1),
landmarks AS (SELECT i - 1 AS ball_no, 'B' || (i - 1) AS ball_id, lms[i].row_id AS landmark_row, lms[i].x1 AS x1, lms[i].x2 AS x2 FROM (SELECT lms, unnest(range(1, len(lms) + 1)) AS i FROM final)),
members AS (SELECT l.ball_id, l.ball_no, l.landmark_row, p.row_id, p.y FROM landmarks l JOIN pts p ON sqrt((l.x1 - p.x1) * (l.x1 - p.x1) + (l.x2 - p.x2) * (l.x2 - p.x2)) <= {RADIUS})"""


def _balls(spark, d):
    return bm.ball_map(table(spark, d, "customer"), "c_acctbal", ["c_nationkey", "c_custkey"], RADIUS, "c_custkey")


@query(
    "tda01_point_cloud",
    f"WITH RECURSIVE {COVER.split('pts AS')[0].rstrip().rstrip(',')} SELECT row_id, round(x1, 6) AS x1, round(x2, 6) AS x2, round(y, 6) AS y FROM scaled",
)
def point_cloud(spark, d):
    customer = table(spark, d, "customer")
    bm.validate(customer, "c_acctbal", ["c_nationkey", "c_custkey"])
    points = bm.point_cloud(customer, "c_acctbal", ["c_nationkey", "c_custkey"], "c_custkey")
    return points.select("row_id", F.round(F.col("vec")[0], 6).alias("x1"), F.round(F.col("vec")[1], 6).alias("x2"), F.round("y", 6).alias("y"))


@query("tda02_landmarks", f"WITH RECURSIVE {COVER} SELECT ball_id, CAST(ball_no AS INTEGER) AS ball_no, landmark_row FROM landmarks")
def landmarks(spark, d):
    return _balls(spark, d).landmarks.select("ball_id", "ball_no", "landmark_row")


@query("tda03_balls", f"WITH RECURSIVE {COVER} SELECT ball_id, landmark_row, count(*) AS n, round(avg(y), 6) AS mean_y FROM members GROUP BY 1, 2")
def balls(spark, d):
    return _balls(spark, d).balls.select("ball_id", "landmark_row", "n", F.round("mean_y", 6).alias("mean_y"))


@query("tda03_membership", f"WITH RECURSIVE {COVER} SELECT ball_id, row_id FROM members")
def membership(spark, d):
    return _balls(spark, d).members.select("ball_id", "row_id")


@query(
    "tda04_connections",
    f"WITH RECURSIVE {COVER}, linked AS (SELECT DISTINCT a.ball_id AS a, b.ball_id AS b FROM members a JOIN members b ON a.row_id = b.row_id AND a.ball_id <> b.ball_id) SELECT a AS ball_id, b AS other FROM linked",
)
def connections(spark, d):
    return bm.connection_lists(_balls(spark, d).edges)


GRID = f"""{COVER.split('pts AS')[0].rstrip().rstrip(',')}, steps AS (SELECT unnest(range(0, 5)) AS i),
grid AS (SELECT 'G' || a.i || b.i AS ball_id, a.i / 4.0 AS x1, b.i / 4.0 AS x2 FROM steps a, steps b),
members AS (SELECT g.ball_id, p.row_id FROM grid g JOIN scaled p ON sqrt((p.x1 - g.x1) * (p.x1 - g.x1) + (p.x2 - g.x2) * (p.x2 - g.x2)) <= {RADIUS})"""


@query(
    "jn11_overlaps",
    f"WITH {GRID} SELECT DISTINCT a.ball_id AS a, b.ball_id AS b FROM members a JOIN members b ON a.row_id = b.row_id AND a.ball_id < b.ball_id",
)
def overlaps(spark, d):
    points = bm.point_cloud(table(spark, d, "customer"), "c_acctbal", ["c_nationkey", "c_custkey"], "c_custkey")
    centres = [(f"G{i}{j}", 5 * i + j, -1, [i / 4.0, j / 4.0]) for i in range(5) for j in range(5)]
    grid = spark.createDataFrame(centres, bm.LANDMARKS)
    return bm.connections(bm.membership(points, grid, RADIUS))


@query(
    "jn13_neighbours",
    f"WITH {KEYWORDED}, {EDGES}, dated AS (SELECT id, {WEEK} AS period FROM docs WHERE ts IS NOT NULL) SELECT DISTINCT d.period, e.target AS id FROM edges e JOIN dated d ON d.id = e.source",
)
def neighbours(spark, d):
    members, _ = gr.temporal_subgraphs(_graph(spark, d), documents(spark, d), "W")
    return members.filter(F.contains("id", F.lit(":")))


@query("tda05_layout")
def layout(spark, d):
    return bm.layout(_balls(spark, d).balls)
