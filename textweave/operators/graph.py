"""Property graph of documents, keywords, clusters and records.

Nodes are (id, label, properties); edges are (source, target, label, properties), undirected. Documents carry ``keywords``
(an array or comma text) and ``cluster`` in their metadata; records are rows with an id column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions.metadata import keyword_list, prefixed_scalars
from textweave.functions.time import period_label, period_start
from textweave.plans.lineage import cut_lineage, written

# Id columns looked up in this order, node labels, length of the text kept on a node.
ID_COLUMNS = ("id", "ID", "doc_id", "document_id", "index")
NODE_LABELS = ("document", "keyword", "cluster", "metadata")
DOCUMENT_EDGES = ("HAS_KEYWORD", "BELONGS_TO_CLUSTER", "HAS_METADATA", "TEMPORAL_LINK")  # those that start from a document
TEXT_LENGTH = 500
HELD = 1_500_000  # linked record nodes that every task holds; links to more are shuffled


def id_column(rows: DataFrame) -> str | None:
    return next((c for c in ID_COLUMNS if c in rows.columns), None)


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _node(df: DataFrame, node: Column, label: str, properties: Column | None = None) -> DataFrame:
    return df.select(node.alias("id"), F.lit(label).alias("label"), (_empty() if properties is None else properties).alias("properties"))


def _edge(df: DataFrame, source: Column, target: Column, label: str) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(label).alias("label"), _empty().alias("properties"))


def _named(kind: str, value: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(value).cast("string"))


# -- nodes ---------------------------------------------------------------------------------------------------------


def document_nodes(documents: DataFrame) -> DataFrame:
    basic = F.create_map(
        F.lit("name"), F.coalesce(F.nullif("name", F.lit("")), "id"), F.lit("text"), F.substring("text", 1, TEXT_LENGTH)
    )
    extra = F.coalesce(prefixed_scalars("metadata"), _empty())
    return _node(documents, F.col("id"), "document", F.map_concat(basic, extra))


def document_keywords(documents: DataFrame) -> DataFrame:
    """(id, keyword), each pair once; ``keywords`` is an array or comma text."""
    listed = F.col("keywords")
    if dict(documents.dtypes)["keywords"] == "string":
        listed = F.filter(keyword_list("keywords"), lambda k: k != "")
    return documents.select("id", F.explode(F.array_distinct(listed)).alias("keyword"))


def document_clusters(documents: DataFrame) -> DataFrame:
    cluster = F.try_element_at("metadata", F.lit("cluster"))
    return documents.select("id", cluster.alias("cluster")).filter(F.col("cluster").isNotNull())


def keyword_nodes(documents: DataFrame) -> DataFrame:
    return _node(document_keywords(documents).select("keyword").distinct(), _named("keyword", "keyword"), "keyword")


def cluster_nodes(documents: DataFrame) -> DataFrame:
    return _node(document_clusters(documents).select("cluster").distinct(), _named("cluster", "cluster"), "cluster")


def metadata_nodes(rows: DataFrame) -> DataFrame:
    """One node per record that has an id and at least one other non-null cell."""
    key = id_column(rows)
    if key is None:
        return _node(rows.limit(0), F.lit(""), "metadata")
    others = [c for c in rows.columns if c not in (key, "row_id")]
    cells = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(c).cast("string") for c in others]))
    properties = F.map_filter(cells, lambda k, v: v.isNotNull())
    return _node(rows, _named("metadata", key), "metadata", properties).filter(F.size("properties") > 0)


# -- edges ---------------------------------------------------------------------------------------------------------


def keyword_edges(documents: DataFrame) -> DataFrame:
    return _edge(document_keywords(documents), F.col("id"), _named("keyword", "keyword"), "HAS_KEYWORD")


def cluster_edges(documents: DataFrame) -> DataFrame:
    return _edge(document_clusters(documents), F.col("id"), _named("cluster", "cluster"), "BELONGS_TO_CLUSTER")


def metadata_edges(rows: DataFrame) -> DataFrame:
    key = id_column(rows)
    if key is None:
        return _edge(rows.limit(0), F.lit(""), F.lit(""), "HAS_METADATA")
    return _edge(rows.filter(F.col(key).isNotNull()), F.col(key).cast("string"), _named("metadata", key), "HAS_METADATA")


def _ids(rows: DataFrame) -> DataFrame:
    key = id_column(rows)
    return rows.select(F.col(key).cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct()


def cluster_keyword_edges(documents: DataFrame) -> DataFrame:
    """Cluster and keyword that occur on the same document."""
    pairs = document_keywords(documents).join(document_clusters(documents), "id").select("cluster", "keyword").distinct()
    return _edge(pairs, _named("cluster", "cluster"), _named("keyword", "keyword"), "CLUSTER_HAS_KEYWORD")


def keyword_metadata_edges(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Keyword of a document and the record of the same id."""
    pairs = document_keywords(documents).join(_ids(rows), "id")
    return _edge(pairs, _named("keyword", "keyword"), _named("metadata", "id"), "KEYWORD_HAS_METADATA")


def cluster_metadata_edges(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Cluster of a document and the record of the same id."""
    pairs = document_clusters(documents).join(_ids(rows), "id")
    return _edge(pairs, _named("cluster", "cluster"), _named("metadata", "id"), "CLUSTER_HAS_METADATA")


def complete_edges(nodes: DataFrame) -> DataFrame:
    """The variant that joins every cluster with every keyword and both with every record.

    Listing it would need as many edges as the node counts multiply to, and each edge says only that both ends exist,
    so it is kept as what it is: for every kind of edge the two node labels and the sizes. Any node of the first label
    is connected to any node of the second.
    """
    sizes = nodes.groupBy("label").agg(F.countDistinct("id").alias("n"))
    kinds = F.explode(
        F.array(
            *[
                F.struct(F.lit(e).alias("label"), F.lit(s).alias("source_label"), F.lit(t).alias("target_label"))
                for e, s, t in (
                    ("CLUSTER_HAS_KEYWORD", "cluster", "keyword"),
                    ("KEYWORD_HAS_METADATA", "keyword", "metadata"),
                    ("CLUSTER_HAS_METADATA", "cluster", "metadata"),
                )
            ]
        )
    ).alias("k")
    blocks = nodes.sparkSession.range(1).select(kinds).select("k.*")
    of = lambda side: sizes.select(F.col("label").alias(f"{side}_label"), F.col("n").alias(f"n_{side}s"))
    joined = blocks.join(of("source"), "source_label").join(of("target"), "target_label")
    return joined.select(
        "label", "source_label", "target_label", "n_sources", "n_targets", (F.col("n_sources") * F.col("n_targets")).alias("n_edges")
    )


# -- the graph -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _core(documents: DataFrame, rows: DataFrame | None) -> DataFrame:
    """What nodes and edges need of the documents, one record each: keywords as a list, the cluster, and whether a row has its id."""
    listed = F.col("keywords")
    if dict(documents.dtypes)["keywords"] == "string":
        listed = F.filter(keyword_list("keywords"), lambda k: k != "")
    core = documents.select(
        "id", "name", F.substring("text", 1, TEXT_LENGTH).alias("text"), "metadata",
        F.array_distinct(F.coalesce(listed, F.array().cast("array<string>"))).alias("keywords"),
        F.try_element_at("metadata", F.lit("cluster")).alias("cluster"),
    )
    if rows is None:
        return core.withColumn("has_row", F.lit(False))
    ids = _ids(rows).withColumn("has_row", F.lit(True))
    return core.join(ids, "id", "left").withColumn("has_row", F.coalesce("has_row", F.lit(False)))


def _listed_edges(core: DataFrame) -> DataFrame:
    """All edges that a document's record tells by itself."""
    edge = lambda source, target, label: F.struct(source.alias("source"), target.alias("target"), F.lit(label).alias("label"))
    keyword = lambda k: F.concat(F.lit("keyword:"), k)
    record, cluster = _named("metadata", "id"), _named("cluster", "cluster")
    some = lambda condition, listed: F.when(condition, listed).otherwise(F.array().cast("array<struct<source:string,target:string,label:string>>"))
    in_cluster, has_row = F.col("cluster").isNotNull(), F.col("has_row")
    parts = [
        F.transform("keywords", lambda k: edge(F.col("id"), keyword(k), "HAS_KEYWORD")),
        some(in_cluster, F.array(edge(F.col("id"), cluster, "BELONGS_TO_CLUSTER"))),
        some(has_row, F.transform("keywords", lambda k: edge(keyword(k), record, "KEYWORD_HAS_METADATA"))),
        some(in_cluster & has_row, F.array(edge(cluster, record, "CLUSTER_HAS_METADATA"))),
    ]
    return core.select(F.explode(F.concat(*parts)).alias("e")).select("e.source", "e.target", "e.label", _empty().alias("properties"))


def build_graph(documents: DataFrame, rows: DataFrame | None = None, require_keywords: bool = True) -> Graph:
    """All nodes and edges, as written tables. Without a single keyword there is nothing to build.

    Documents and rows are read once each: a record per document is written first, and everything is told from it.
    """
    rows = None if rows is None or id_column(rows) is None else cut_lineage(rows)
    core = written(_core(documents, rows), "graph-core")
    if require_keywords and core.filter(F.size("keywords") > 0).isEmpty():
        raise ValueError("no document has keywords; assign them first")
    pairs = core.filter(F.col("cluster").isNotNull()).select("cluster", F.explode("keywords").alias("keyword")).distinct()
    nodes = [document_nodes(core), keyword_nodes(core), cluster_nodes(core)]
    edges = [_listed_edges(core), _edge(pairs, _named("cluster", "cluster"), _named("keyword", "keyword"), "CLUSTER_HAS_KEYWORD")]
    if rows is not None:
        nodes.append(metadata_nodes(rows))
        edges.append(metadata_edges(rows))
    union = lambda parts, label: written(reduce(lambda a, b: a.unionByName(b), parts), label)
    return Graph(union(nodes, "graph-nodes"), union(edges, "graph-edges"))


def graph_counts(graph: Graph) -> DataFrame:
    """One record: numbers of nodes, edges and documents, and which kinds of node there are."""
    has = lambda label: F.coalesce(F.bool_or(F.col("label") == label), F.lit(False)).alias(f"has_{label}s")
    n = graph.nodes.agg(
        F.count(F.lit(1)).alias("num_nodes"), F.count_if(F.col("label") == "document").alias("num_documents"),
        has("keyword"), has("cluster"), F.coalesce(F.bool_or(F.col("label") == "metadata"), F.lit(False)).alias("has_metadata"),
    ).withColumn("_k", F.lit(1))
    e = graph.edges.agg(F.count(F.lit(1)).alias("num_edges")).withColumn("_k", F.lit(1))
    return n.join(e, "_k").drop("_k")


def filter_nodes(graph: Graph, labels: Sequence[str]) -> Graph:
    """Nodes of the given labels and the edges between them; unknown labels are ignored, none left means all."""
    wanted = [p for p in (x.strip().lower() for x in labels) if p in NODE_LABELS]
    if not wanted:
        return graph
    nodes = graph.nodes.filter(F.col("label").isin(wanted))
    ids = nodes.select("id").distinct()
    both = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return Graph(nodes, both.select(*graph.edges.columns))


def temporal_edges(graph: Graph, links: DataFrame, rows: DataFrame) -> DataFrame:
    """TEMPORAL_LINK edges from documents to the record node of each linked row, with gap and link type."""
    key = id_column(rows)
    named = rows.select("row_id", _named("metadata", key).alias("target"))
    known = graph.nodes.filter(F.col("label") == "metadata").select(F.col("id").alias("target")).distinct()
    # links are many times the rows: they meet one table of the rows that have a node, where they are made
    met = cut_lineage(named.join(known, "target", "left_semi"))
    joined = links.join(F.broadcast(met) if met.limit(HELD + 1).count() <= HELD else met, "row_id")
    properties = F.create_map(
        F.lit("time_gap"), F.coalesce("gap", F.lit(0.0)).cast("string"), F.lit("link_type"), F.col("link_type")
    )
    return joined.select(F.col("doc_id").alias("source"), "target", F.lit("TEMPORAL_LINK").alias("label"), properties.alias("properties"))


def temporal_subgraphs(
    graph: Graph, documents: DataFrame, period: str = "W", links: DataFrame | None = None, rows: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges per period: (period, id) and (period, source, target, label, properties).

    A period holds its documents, the keywords, clusters and records next to them, and the edges among these.
    """
    dated = documents.filter(F.col("ts").isNotNull()).select("id", period_label(period_start("ts", period), period).alias("period"))
    docs = dated.withColumnRenamed("id", "source")
    # the label tells what an edge starts from; an id may look like anything
    from_document = F.col("label").isin(*DOCUMENT_EDGES)
    own = graph.edges.filter(from_document)
    outgoing = own.join(docs, "source")
    members = dated.unionByName(outgoing.select(F.col("target").alias("id"), "period")).distinct()
    # targets are many and sources few: a cluster with a large share of the edges never is a join key of its own
    shared = (
        graph.edges.filter(~from_document)
        .join(members.withColumnRenamed("id", "target"), "target")
        .join(members.withColumnRenamed("id", "source"), ["period", "source"], "left_semi")
    )
    columns = ["period", "source", "target", "label", "properties"]
    edges = outgoing.select(*columns).unionByName(shared.select(*columns))
    if links is not None and rows is not None:
        timed = temporal_edges(graph, links, rows).join(docs, "source")
        inside = timed.join(members.withColumnRenamed("id", "target"), ["period", "target"], "left_semi")
        edges = edges.unionByName(inside.select(*columns))
    return members.select("period", "id"), edges
