"""Queries: filters, lookups, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textweave.functions import metadata as meta
from textweave.functions import text as tx
from textweave.functions import time as tm
from textweave.functions import vectors as vec
from textweave.operators import filters as flt
from textweave.operators import linkage
from textweave.operators.words import ordered_distinct
from textweave.registry.frames import (
    DIRTY_ROWS,
    DOCS,
    EVENT_ROWS,
    dirty_rows,
    documents,
    event_rows,
    flat,
    label_rows,
    query,
    sql_words,
    table,
)

SHORT = ["id", "name", "ts"]

RELATIONS = """relations AS (
  SELECT 'text:' || lang AS first, 'numb:n_chars' AS second, 'length' AS relation FROM documents GROUP BY lang
  UNION ALL SELECT 'text:' || source, 'numb:value', 'origin' FROM documents GROUP BY source)"""


def relations(spark, d):
    raw = table(spark, d, "documents")
    one = lambda c, second, rel: raw.select(
        F.concat(F.lit("text:"), c).alias("first"), F.lit(f"numb:{second}").alias("second"), F.lit(rel).alias("relation")
    ).distinct()
    return one("lang", "n_chars", "length").unionByName(one("source", "value", "origin"))


@query("flt01_include_columns", "SELECT event_type, value FROM events")
def include(spark, d):
    return flt.include_columns(table(spark, d, "events"), ["event_type", "absent"], "value")


@query("flt02_numeric_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def numeric(spark, d):
    return flt.keep_numeric(table(spark, d, "customer"))


@query("flt03_drop_missing", f"WITH {DIRTY_ROWS} SELECT row_id, value, event_type FROM dirty WHERE value IS NOT NULL AND event_type <> ''")
def drop_missing(spark, d):
    return flt.drop_missing(dirty_rows(spark, d).select("row_id", "value", "event_type"))


@query("flt03_drop_null", f"WITH {DIRTY_ROWS} SELECT row_id, value, event_type FROM dirty WHERE value IS NOT NULL")
def drop_null(spark, d):
    return flt.drop_missing(dirty_rows(spark, d).select("row_id", "value", "event_type"), empty_is_missing=False)


@query("flt04_drop_duplicates", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def drop_duplicates(spark, d):
    return flt.drop_duplicates(table(spark, d, "part").select("p_brand", "p_type", "p_size"))


@query("flt05_rows_equal", "SELECT p_partkey, p_size FROM part WHERE p_size = 20")
def rows_equal(spark, d):
    return flt.rows_equal(table(spark, d, "part"), "p_size", "20").select("p_partkey", "p_size")


@query(
    "flt06_filter_documents",
    f"WITH {DOCS} SELECT id, name, ts FROM docs WHERE contains(source, 'src1') OR contains(id, 'src1') OR contains(name, 'src1')",
)
def filter_documents(spark, d):
    return flt.filter_documents(documents(spark, d), "source", "src1").select(*SHORT)


@query(
    "flt07_rows_of_documents",
    "SELECT l.doc_id AS row_id, l.quality FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr' "
    "OR contains(source || '-' || doc_id || '.txt', 'fr'))",
)
def rows_of_documents(spark, d):
    docs = flt.filter_documents(documents(spark, d), "lang", "fr")
    return flt.rows_of_documents(label_rows(spark, d), docs).select("row_id", "quality")


@query("flt08_filtered_rows", "SELECT doc_id AS row_id, quality, toxic FROM labels WHERE quality = 1 AND toxic = 0")
def filtered_rows(spark, d):
    _, rows = flt.apply_filters(documents(spark, d), label_rows(spark, d), ["quality=1", "toxic:0"])
    return rows.select("row_id", "quality", "toxic")


@query(
    "flt08_filtered_documents",
    f"WITH {DOCS} SELECT id, name, ts FROM docs WHERE (contains(lang, 'fr') OR contains(name, 'fr')) AND (contains(source, 'src3') OR contains(name, 'src3'))",
)
def filtered_documents(spark, d):
    return flt.apply_filters(documents(spark, d), label_rows(spark, d), ["lang=fr", "source:src3"])[0].select(*SHORT)


@query("flt09_id_filter", "SELECT doc_id AS row_id, quality FROM labels WHERE doc_id = 4")
def id_filter(spark, d):
    _, rows = flt.apply_filters(documents(spark, d), label_rows(spark, d), ["id=4"])
    return rows.select("row_id", "quality")


@query("flt09_id_filter_documents", f"WITH {DOCS} SELECT id, name FROM docs WHERE contains(id, '4') OR contains(name, '4')")
def id_filter_documents(spark, d):
    """The document side of the same filter: any id or name that holds the value."""
    docs, _ = flt.apply_filters(documents(spark, d), label_rows(spark, d), ["id=4"])
    return docs.select("id", "name")


@query(
    "flt10_id_sync",
    "SELECT l.doc_id AS row_id, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE contains(d.source, 'src2') OR contains(d.source || '-' || d.doc_id || '.txt', 'src2')",
)
def id_sync(spark, d):
    _, rows = flt.apply_filters(documents(spark, d), label_rows(spark, d), ["source=src2", "id:"])
    return rows.select("row_id", "quality")


WINDOW_LINKS = f"""{DOCS}, {EVENT_ROWS}, window_links AS (
  SELECT d.id AS doc_id, e.row_id, (epoch_us(e.ts) - epoch_us(d.ts)) / 1e6 AS gap
  FROM docs d JOIN event_rows e ON e.ts BETWEEN d.ts - INTERVAL 5 MINUTE AND d.ts + INTERVAL 5 MINUTE)"""


@query(
    "flt11_rows_linked_from_documents",
    f"WITH {WINDOW_LINKS} SELECT row_id, value FROM event_rows WHERE row_id IN (SELECT w.row_id FROM window_links w JOIN docs d ON d.id = w.doc_id WHERE d.lang = 'en' OR contains(d.name, 'en'))",
)
def rows_linked(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    links = linkage.link_by_time_window(docs, rows)
    return flt.apply_filters(docs, rows, ["lang=en", "temporal:text"], links)[1].select("row_id", "value")


@query(
    "flt12_documents_linked_to_rows",
    f"WITH {WINDOW_LINKS} SELECT id, name, ts FROM docs WHERE id IN (SELECT w.doc_id FROM window_links w JOIN event_rows e USING (row_id) WHERE e.event_type = 'click')",
)
def documents_linked(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    links = linkage.link_by_time_window(docs, rows)
    clicks = flt.rows_equal(rows, "event_type", "click")
    return flt.apply_filters(docs, clicks, ["temporal:df"], links)[0].select(*SHORT)


@query(
    "flt13_time_range",
    f"WITH {DOCS} SELECT id, name, ts FROM docs WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 12:00:00')",
)
def time_range(spark, d):
    return flt.in_time_range(documents(spark, d), "ts", "2024-01-05", "2024-01-12 12:00:00").select(*SHORT)


@query("flt14_document_by_id", f"WITH {DOCS} SELECT id, name, ts FROM docs WHERE id = '7'")
def document_by_id(spark, d):
    return flt.document_by_id(documents(spark, d), "7").select(*SHORT)


@query("flt14_document_ids", f"WITH {DOCS} SELECT id FROM docs")
def document_ids(spark, d):
    return flt.document_ids(documents(spark, d))


@query("flt16_relationships", f"WITH {RELATIONS} SELECT * FROM relations WHERE contains(first, 'src') OR contains(second, 'src') UNION ALL SELECT 'text:src', 'numb:k', 'added'")
def relationships(spark, d):
    added = flt.add_relationship(relations(spark, d), "text:src", "numb:k", "added")
    return flt.relationships_for(added, "src")


@query("flt17_temporal_relationship", f"WITH {RELATIONS} SELECT * FROM relations UNION ALL SELECT 'text:7', 'numb:value', 'temporal_correlation'")
def temporal_relationship(spark, d):
    return flt.add_temporal_relationship(relations(spark, d), documents(spark, d), event_rows(spark, d), "7", "value")


@query("flt18_filter_rows", f"WITH {EVENT_ROWS} SELECT row_id, value, k FROM event_rows WHERE value > 10 AND k < 50")
def filter_rows(spark, d):
    return flt.filter_rows(event_rows(spark, d), "value > 10 and k < 50").select("row_id", "value", "k")


@query(
    "flt18_group_aggregate",
    f"WITH {EVENT_ROWS} SELECT event_type, round(avg(value), 6) AS mean_value, max(k) AS max_k, count(*) AS n FROM event_rows GROUP BY event_type",
)
def group_aggregate(spark, d):
    return flt.group_aggregate(
        event_rows(spark, d), ["event_type"], {"mean_value": "round(avg(value), 6)", "max_k": "max(k)", "n": "count(*)"}
    )


@query("flt18_top_rows", f"WITH {EVENT_ROWS} SELECT row_id, value FROM event_rows ORDER BY value DESC, row_id LIMIT 25")
def top_rows(spark, d):
    return flt.top_rows(event_rows(spark, d).select("row_id", "value"), ["value desc", "row_id"], 25)


@query("flt19_features", "SELECT o_orderkey, o_custkey FROM orders")
def features(spark, d):
    return flt.split_xy(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice")[0]


@query("flt19_outcome", "SELECT o_totalprice FROM orders")
def outcome(spark, d):
    return flt.split_xy(table(spark, d, "orders"), "o_totalprice")[1]


# -- set operations ------------------------------------------------------------------------------------------------


@query(
    "set03_ordered_distinct",
    "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text",
)
def distinct_texts(spark, d):
    return ordered_distinct(table(spark, d, "documents").select("text", "doc_id"), "text", ["doc_id"])


@query(
    "set04_add_documents",
    f"WITH {DOCS} SELECT id, md5(text) AS text_md5 FROM docs UNION ALL SELECT url, md5(html) FROM pages",
)
def add_documents(spark, d):
    from textweave.sources.ingest import pages_to_documents

    both = flt.add_documents(documents(spark, d), pages_to_documents(table(spark, d, "pages")))
    return both.select("id", F.md5("text").alias("text_md5"))


@query(
    "set05_shared_words",
    f"""WITH a AS (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM documents),
b AS (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM benchmark) SELECT word FROM a INTERSECT SELECT word FROM b""",
)
def shared_words(spark, d):
    own = lambda t: table(spark, d, t).select(F.explode(tx.words("text")).alias("word"))
    return own("documents").intersect(own("benchmark"))


@query("set06_remove_documents", f"WITH {DOCS} SELECT id, name, ts FROM docs WHERE num NOT IN (SELECT doc_id FROM labels)")
def remove_documents(spark, d):
    listed = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return flt.remove_documents(documents(spark, d), listed).select(*SHORT)


# -- scalar functions ----------------------------------------------------------------------------------------------

_normal = "text"
for _pattern, _placeholder in tx.PLACEHOLDERS:
    _normal = f"regexp_replace({_normal}, '{_pattern}', '{_placeholder}', 'g')"


@query("scl01_normalise_text", f"SELECT doc_id, md5(lower({_normal})) AS text_md5 FROM documents")
def normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normalise_text("text")).alias("text_md5"))


CHUNKS = """chunk_starts AS (
  SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 500) / 450.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0),
raw_chunks AS (SELECT doc_id, i, substr(text, CAST(i * 450 + 1 AS BIGINT), 500) AS chunk FROM chunk_starts),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, chunk FROM raw_chunks
  WHERE regexp_replace(chunk, '\\s+', '', 'g') <> '')"""


@query("scl02_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5 FROM chunks")
def chunks(spark, d):
    cells = table(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks("text")).alias("chunk_no", "chunk"))
    return cells.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


@query("scl03_parse_timestamp", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts FROM events")
def parse(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, d, "events").select("event_id", tm.parse_timestamp(text).alias("ts"))


@query(
    "scl04_period_labels",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d,
  CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) || '/' || CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS VARCHAR) AS w,
  strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y') AS y FROM orders""",
)
def labels(spark, d):
    label = lambda p: tm.period_label(tm.period_start("o_orderdate", p), p).alias(p.lower())
    return table(spark, d, "orders").select("o_orderkey", *[label(p) for p in "DWMY"])


@query(
    "scl05_gap_seconds",
    """SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 1e6, 6) AS signed_gap,
  round(abs((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 1e6), 6) AS absolute_gap FROM events""",
)
def gaps(spark, d):
    gap = tm.gap_seconds("ts", F.expr("timestamp_ntz'2024-01-15 00:00:00'"))
    return table(spark, d, "events").select("event_id", F.round(gap, 6).alias("signed_gap"), F.round(F.abs(gap), 6).alias("absolute_gap"))


@query(
    "scl06_euclidean",
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS a, [CAST(x AS DOUBLE) for x in list_reverse(embedding)] AS b FROM embeddings)
SELECT vec_id, round(list_distance(a, b), 6) AS distance, round(1 / (1 + list_distance(a, b)), 6) AS similarity FROM v""",
)
def euclidean(spark, d):
    dist = vec.euclidean_distance("embedding", F.reverse("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(dist, 6).alias("distance"), F.round(vec.distance_similarity(dist), 6).alias("similarity"))


@query(
    "scl07_cosine",
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS a, [CAST(x AS DOUBLE) for x in list_reverse(embedding)] AS b FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(1 - (1 - list_cosine_similarity(a, b)) / 2, 6) AS score FROM v""",
)
def cosine(spark, d):
    c = vec.cosine_similarity("embedding", F.reverse("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(c, 6).alias("cosine"), F.round(vec.similarity_from_distance(1 - c), 6).alias("score"))


THREE = "(event_id % 7) / 7.0 AS a, (event_id % 5) / 5.0 AS b, (event_id % 3) / 3.0 AS c"


@query(
    "scl08_sentiment_label",
    f"WITH s AS (SELECT event_id, {THREE} FROM events) SELECT event_id, CASE WHEN a >= b AND a >= c THEN 'neg' WHEN b >= c THEN 'neu' ELSE 'pos' END AS label FROM s",
)
def sentiment_label(spark, d):
    part = lambda n: F.col("event_id") % n / float(n)
    return table(spark, d, "events").select("event_id", meta.sentiment_label(part(7), part(5), part(3)).alias("label"))


@query(
    "scl09_sentiment_score",
    "SELECT doc_id, CAST(CASE quality WHEN 1 THEN 1 ELSE -1 END AS DOUBLE) AS quality_score, CAST(0 AS DOUBLE) AS other_score FROM labels",
)
def sentiment_score(spark, d):
    word = F.when(F.col("quality") == 1, "Positive").otherwise("NEG")
    return table(spark, d, "labels").select(
        "doc_id", meta.sentiment_score(word).alias("quality_score"), meta.sentiment_score(F.lit("Neutral")).alias("other_score")
    )


@query("scl10_keyword_list", "SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS keywords, 3 AS n FROM part")
def keyword_list(spark, d):
    listed = meta.keyword_list(F.concat_ws(" , ", "p_brand", "p_type", "p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(listed, "|").alias("keywords"), F.size(listed).alias("n"))


@query("scl11_json_scalars", "SELECT event_id, 'doc_k=' || regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS properties FROM events")
def json_scalars(spark, d):
    scalars = meta.prefixed_scalars(meta.json_scalars("props"))
    return table(spark, d, "events").select("event_id", scalars.alias("properties")).select("event_id", flat().alias("properties"))


@query(
    "scl13_edit_similarity",
    "SELECT c_custkey, round(1 - levenshtein(c_name, c_mktsegment) / CAST(greatest(length(c_name), length(c_mktsegment)) AS DOUBLE), 6) AS similarity FROM customer",
)
def edit_similarity(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(tx.edit_similarity("c_name", "c_mktsegment"), 6).alias("similarity"))


@query(
    "scl14_kept_tokens",
    r"""WITH raw AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'),
    lambda t: regexp_replace(t, '^[^\p{L}\p{M}\p{N}\p{Pc}@#]+|[^\p{L}\p{M}\p{N}\p{Pc}]+$', '', 'g')) AS ts FROM documents),
kept AS (SELECT doc_id, list_filter(ts, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[+-]?\d[\d.,:/%-]*$')
    AND NOT regexp_matches(t, '^(https?://|www\.)') AND NOT regexp_matches(t, '^[^@\s]+@[^@\s]+\.[^@\s]+$')
    AND NOT (upper(t) = t AND lower(t) <> t) AND lower(t) NOT IN ('the', 'and', 'une')) AS ks FROM raw)
SELECT doc_id, len(ks) AS n, md5(array_to_string(ks, ' ')) AS tokens_md5 FROM kept""",
)
def kept_tokens(spark, d):
    kept = tx.kept_tokens("text", ["the", "and", "une"])
    cells = table(spark, d, "documents").select("doc_id", kept.alias("ks"))
    return cells.select("doc_id", F.size("ks").cast("bigint").alias("n"), F.md5(F.array_join("ks", " ")).alias("tokens_md5"))
