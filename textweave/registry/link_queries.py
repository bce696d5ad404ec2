"""Queries: linkage joins, outcomes, periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from textweave.operators import features as fea
from textweave.operators import linkage, ml, temporal
from textweave.operators.filters import document_ids
from textweave.registry.filter_queries import WINDOW_LINKS
from textweave.registry.frames import (
    DOCS,
    EVENT_ROWS,
    KEYWORDED,
    document_stream,
    documents,
    event_rows,
    keyworded,
    label_rows,
    query,
    sql_white,
    sql_words,
    table,
)
from textweave.session import new_folder
from textweave.streaming import windows


@query("jn01_link_by_id", "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, l.doc_id AS row_id, 'id' AS link_type FROM documents d JOIN labels l USING (doc_id)")
def by_id(spark, d):
    return linkage.link_by_id(documents(spark, d), label_rows(spark, d)).select("doc_id", "row_id", "link_type")


NEAREST = f"""{DOCS}, {EVENT_ROWS},
before AS (SELECT d.id, d.ts AS doc_ts, e.ts AS row_ts FROM docs d ASOF JOIN event_rows e ON d.ts >= e.ts WHERE d.ts IS NOT NULL),
after AS (SELECT d.id, d.ts AS doc_ts, e.ts AS row_ts FROM docs d ASOF JOIN event_rows e ON d.ts <= e.ts WHERE d.ts IS NOT NULL),
both_sides AS (SELECT * FROM before UNION ALL SELECT * FROM after),
candidates AS (
  SELECT b.id AS doc_id, e.row_id, abs(epoch_us(b.row_ts) - epoch_us(b.doc_ts)) AS micros FROM both_sides b JOIN event_rows e ON e.ts = b.row_ts),
nearest AS (
  SELECT doc_id, row_id, micros / 1e6 AS gap FROM candidates QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY micros, row_id) = 1)"""


@query("jn02_nearest_time", f"WITH {NEAREST} SELECT doc_id, row_id, round(gap, 6) AS gap FROM nearest")
def nearest(spark, d):
    links = linkage.link_by_nearest_time(documents(spark, d), event_rows(spark, d))
    return links.select("doc_id", "row_id", F.round("gap", 6).alias("gap"))


@query("jn02_nearest_time_max_gap", f"WITH {NEAREST} SELECT doc_id, row_id, round(gap, 6) AS gap FROM nearest WHERE gap <= 60")
def nearest_gap(spark, d):
    links = linkage.link_by_nearest_time(documents(spark, d), event_rows(spark, d), max_gap=60)
    return links.select("doc_id", "row_id", F.round("gap", 6).alias("gap"))


@query("jn03_time_window", f"WITH {WINDOW_LINKS} SELECT doc_id, row_id, round(gap, 6) AS gap FROM window_links")
def window(spark, d):
    links = linkage.link_by_time_window(documents(spark, d), event_rows(spark, d))
    return links.select("doc_id", "row_id", F.round("gap", 6).alias("gap"))


WEEK = "CAST(CAST(date_trunc('week', {0}) AS DATE) AS VARCHAR) || '/' || CAST(CAST(date_trunc('week', {0}) AS DATE) + 6 AS VARCHAR)"


@query(
    "jn04_same_period",
    f"""WITH {DOCS}, {EVENT_ROWS}, r AS (SELECT {WEEK.format('ts')} AS period, count(*) AS n FROM event_rows GROUP BY 1)
SELECT d.id AS doc_id, r.period, r.n AS n_links FROM docs d JOIN r ON r.period = {WEEK.format('d.ts')}""",
)
def same_period(spark, d):
    links = linkage.link_by_period(documents(spark, d), event_rows(spark, d), period="W")
    return links.counts().select("doc_id", F.col("hub").alias("period"), "n_links")


@query(
    "jn04_period_sizes",
    f"""WITH {DOCS}, {EVENT_ROWS}, r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, count(*) AS n FROM event_rows GROUP BY 1),
q AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, count(*) AS n FROM docs WHERE ts IS NOT NULL GROUP BY 1)
SELECT period, q.n AS n_documents, r.n AS n_rows, q.n * r.n AS n_links FROM q JOIN r USING (period)""",
)
def period_sizes(spark, d):
    links = linkage.link_by_period(documents(spark, d), event_rows(spark, d), period="D")
    return links.hub_sizes().withColumnRenamed("hub", "period")


def _text_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query("jn05_embedding_links")
def embedding_links(spark, d):
    rows = linkage.numeric_vectors(event_rows(spark, d), ["value", "user_id", "k"])
    return linkage.link_by_embedding(_text_vectors(spark, d), rows, top_k=3, threshold=0.2)


# event numbers filled with their mean and scaled by the population deviation of the filled column, and vectors as long
SCALED = EVENT_ROWS + """, filled AS (
  SELECT row_id, coalesce(CAST(value AS DOUBLE), avg(value) OVER ()) AS a, coalesce(CAST(user_id AS DOUBLE), avg(user_id) OVER ()) AS b, coalesce(CAST(k AS DOUBLE), avg(k) OVER ()) AS c FROM event_rows),
moments AS (SELECT avg(a) AS ma, stddev_pop(a) AS da, avg(b) AS mb, stddev_pop(b) AS db, avg(c) AS mc, stddev_pop(c) AS dc FROM filled),
row_vectors AS (SELECT row_id, [(a - ma) / da, (b - mb) / db, (c - mc) / dc] AS p FROM filled, moments),
text_vectors AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings)"""


def _short_vectors(spark, d):
    return _text_vectors(spark, d).withColumn("vec", F.slice("vec", 1, 3))


@query(
    "jn05_links_of_given_vectors",
    f"""WITH {SCALED}, s AS (SELECT doc_id, row_id, list_cosine_similarity(q, p) AS score FROM text_vectors, row_vectors)
SELECT doc_id, row_id, round(score, 6) AS score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_id) <= 3) WHERE score >= 0.2""",
)
def links_of_given_vectors(spark, d):
    """Vectors of equal length on both sides need no projection, so SQL can compare every pair."""
    rows = linkage.numeric_vectors(event_rows(spark, d), ["value", "user_id", "k"])
    links = linkage.link_by_embedding(_short_vectors(spark, d), rows, top_k=3, threshold=0.2)
    return links.select("doc_id", "row_id", F.round("score", 6).alias("score"))


@query(
    "sem07_nearest_of_given_vectors",
    f"""WITH {SCALED}, s AS (SELECT doc_id, row_id, list_distance(q, p) AS distance FROM text_vectors, row_vectors)
SELECT doc_id, row_id, round(1 / (1 + distance), 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY distance, row_id) AS INTEGER) AS rank
FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, row_id) <= 5""",
)
def nearest_of_given_vectors(spark, d):
    rows = linkage.numeric_vectors(event_rows(spark, d), ["value", "user_id", "k"])
    texts, numbers = linkage.common_space(_short_vectors(spark, d), rows)
    found = linkage.top_similar(texts, numbers, 5, "doc_id", "row_id", "euclidean")
    return found.withColumn("score", F.round("score", 6))


@query(
    "jn06_keyword_hubs",
    f"""WITH {KEYWORDED}, dk AS (SELECT keyword, count(DISTINCT id) AS n FROM keywords GROUP BY keyword),
pw AS (SELECT DISTINCT item_id, unnest({sql_words('text')}) AS keyword FROM benchmark), rk AS (SELECT keyword, count(*) AS n FROM pw GROUP BY keyword)
SELECT keyword, dk.n AS n_documents, rk.n AS n_rows, dk.n * rk.n AS n_links FROM dk JOIN rk USING (keyword)""",
)
def keyword_hubs(spark, d):
    words = keyworded(spark, d).select(F.col("id").alias("doc_id"), F.explode("keywords").alias("keyword"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    return linkage.link_by_keyword(words, rows, "text").hub_sizes().withColumnRenamed("hub", "keyword")


@query(
    "jn07_metadata_export",
    f"""WITH {DOCS} SELECT coalesce(CAST(l.doc_id AS VARCHAR), d.id) AS id, l.quality, d.lang, d.source
FROM labels l FULL OUTER JOIN docs d ON d.num = l.doc_id""",
)
def metadata_export(spark, d):
    rows = label_rows(spark, d).select("id", "quality")
    return linkage.metadata_export(documents(spark, d), rows, ["lang", "source"])


@query(
    "jn07_export_of_all_keys",
    f"""WITH {DOCS} SELECT coalesce(CAST(l.doc_id AS VARCHAR), d.id) AS id, l.quality, d.lang, CAST(d.n_chars AS VARCHAR) AS n_chars, d.source
FROM labels l FULL OUTER JOIN docs d ON d.num = l.doc_id""",
)
def export_of_all_keys(spark, d):
    return linkage.metadata_export(documents(spark, d), label_rows(spark, d).select("id", "quality"))


@query(
    "jn08_text_outcome",
    f"""WITH {NEAREST}, votes AS (
  SELECT n.row_id, d.lang AS value, count(*) AS c, min(d.num) AS first_id FROM nearest n JOIN docs d ON d.id = n.doc_id GROUP BY 1, 2)
SELECT row_id, value FROM votes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY c DESC, first_id) = 1""",
)
def text_outcome(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    return linkage.text_outcome(docs, linkage.link_by_nearest_time(docs, rows), "lang")


@query(
    "jn08_text_outcome_by_period",
    f"""WITH {DOCS}, {EVENT_ROWS}, votes AS (
  SELECT CAST(ts AS DATE) AS day, lang AS value, count(*) AS c, min(num) AS first_id FROM docs WHERE ts IS NOT NULL GROUP BY 1, 2),
best AS (SELECT day, value FROM votes QUALIFY row_number() OVER (PARTITION BY day ORDER BY c DESC, first_id) = 1)
SELECT e.row_id, b.value FROM event_rows e JOIN best b ON b.day = CAST(e.ts AS DATE)""",
)
def text_outcome_period(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    return linkage.text_outcome(docs, linkage.link_by_period(docs, rows, period="D"), "lang")


@query(
    "jn09_aligned_outcome",
    "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, md5(d.text) AS text_md5, l.quality AS outcome FROM documents d JOIN labels l USING (doc_id)",
)
def aligned(spark, d):
    both = linkage.align_text_outcome(documents(spark, d), label_rows(spark, d), "quality")
    return both.select("doc_id", F.md5("text").alias("text_md5"), "outcome")


@query(
    "jn10_period_outer_join",
    f"""WITH {DOCS}, r AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, round(avg(o_totalprice), 4) AS value_mean FROM orders GROUP BY 1),
q AS (SELECT strftime(ts, '%Y-%m') AS period, count(*) AS document_count FROM docs WHERE ts IS NOT NULL GROUP BY 1)
SELECT coalesce(r.period, q.period) AS period, value_mean, document_count FROM r FULL OUTER JOIN q ON r.period = q.period""",
)
def period_outer(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    out = temporal.temporal_summary(documents(spark, d), rows, period="M", columns=["value"])
    return out.select("period", F.round("value_mean", 4).alias("value_mean"), "document_count")


@query(
    "agg15_link_statistics",
    f"""WITH {NEAREST} SELECT (SELECT count(*) FROM docs) AS total_documents, count(DISTINCT doc_id) AS linked_documents, count(*) AS total_links,
  round(avg(1 / (1 + gap)), 6) AS avg_similarity, round(min(1 / (1 + gap)), 6) AS min_similarity, round(max(1 / (1 + gap)), 6) AS max_similarity FROM nearest""",
)
def link_statistics(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    links = linkage.link_by_nearest_time(docs, rows).withColumn("score", 1 / (1 + F.col("gap")))
    stats = linkage.link_statistics(document_ids(docs), links)
    rounded = [F.round(c, 6).alias(c) for c in ("avg_similarity", "min_similarity", "max_similarity")]
    return stats.select("total_documents", "linked_documents", "total_links", *rounded)


REDUCED = f"""{WINDOW_LINKS}, votes AS (
  SELECT w.row_id, d.source AS value, count(*) AS c, min(d.num) AS first_id FROM window_links w JOIN docs d ON d.id = w.doc_id GROUP BY 1, 2)"""


@query("agg07_majority", f"WITH {REDUCED} SELECT row_id, value FROM votes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY c DESC, first_id) = 1")
def majority(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    return linkage.outcome_by_time_window(docs, rows, "source", "majority")


@query("agg07_first", f"WITH {REDUCED} SELECT row_id, value FROM votes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY first_id) = 1")
def first(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    return linkage.outcome_by_time_window(docs, rows, "source", "first")


@query(
    "agg07_mean",
    f"WITH {WINDOW_LINKS} SELECT w.row_id, round(avg(d.n_chars), 6) AS value FROM window_links w JOIN docs d ON d.id = w.doc_id GROUP BY 1",
)
def mean(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    out = linkage.outcome_by_time_window(docs, rows, "n_chars", "mean")
    return out.select("row_id", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(
    "win05_top_links",
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS a FROM embeddings),
s AS (SELECT q.vec_id AS doc_id, p.vec_id AS row_id, list_cosine_similarity(q.a, p.a) AS score FROM v q, v p)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_id) AS INTEGER) AS rank
FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_id) <= 5""",
)
def top_links(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"))
    found = linkage.top_similar(_text_vectors(spark, d), points, 5, "doc_id", "row_id")
    return found.select("doc_id", "row_id", F.round("score", 6).alias("score"), "rank")


# -- periods -------------------------------------------------------------------------------------------------------

FIVE = ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, count({c}) AS {c}_count"
    for c in ("value", "k")
)


@query(
    "agg01_temporal_summary",
    f"""WITH {DOCS}, {EVENT_ROWS}, r AS (SELECT {WEEK.format('ts')} AS period, {FIVE} FROM event_rows GROUP BY 1),
q AS (SELECT {WEEK.format('ts')} AS period, count(*) AS document_count FROM docs WHERE ts IS NOT NULL GROUP BY 1)
SELECT coalesce(r.period, q.period) AS period, r.* EXCLUDE (period), document_count FROM r FULL OUTER JOIN q ON r.period = q.period""",
)
def temporal_summary(spark, d):
    out = temporal.temporal_summary(documents(spark, d), event_rows(spark, d), period="W", columns=["value", "k"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_mean", "_std"))})


def _labelled(spark, d, docs=None):
    """Documents, a stream or a table, with a sentiment label taken from the quality label."""
    word = F.when(F.col("quality") == 1, "pos").when(F.col("toxic") == 1, "neg").otherwise("neutral")
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), word.alias("s"))
    docs = documents(spark, d) if docs is None else docs
    return docs.join(labels, "id").withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("sentiment"), "s"))).drop("s")


SCORED = f"""{DOCS}, scored AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, CAST(CASE WHEN quality = 1 THEN 1 WHEN toxic = 1 THEN -1 ELSE 0 END AS DOUBLE) AS s
  FROM docs JOIN labels ON num = doc_id WHERE ts IS NOT NULL)"""


def _trend(how: str, sql: str) -> None:
    @query(
        f"agg02_sentiment_{how}",
        f"WITH {SCORED} SELECT period, round({sql}, 6) AS sentiment_score, count(*) AS document_count FROM scored GROUP BY period",
    )
    def trend(spark, d):
        out = temporal.sentiment_trend(_labelled(spark, d), "D", how)
        return out.withColumn("sentiment_score", F.round("sentiment_score", 6))


for _how, _sql in (("mean", "avg(s)"), ("median", "median(s)"), ("max", "max(s)"), ("min", "min(s)")):
    _trend(_how, _sql)

PASSED_OVER = ["that", "with", "this", "pour", "dans", "para", "sich", "nicht"]  # this query's own choice
STOPS = ", ".join(f"'{w}'" for w in PASSED_OVER)


@query(
    "agg03_period_topics",
    f"""WITH {DOCS}, cells AS (SELECT {WEEK.format('ts')} AS period, unnest({sql_white('text')}) AS topic FROM docs WHERE ts IS NOT NULL),
counted AS (SELECT period, topic, count(*) AS n FROM cells WHERE length(topic) > 3 AND topic NOT IN ({STOPS}) GROUP BY 1, 2)
SELECT period, CAST(row_number() OVER (PARTITION BY period ORDER BY n DESC, topic) AS INTEGER) AS rank, topic, n FROM counted
QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, topic) <= 5""",
)
def period_topics(spark, d):
    return temporal.top_topics(documents(spark, d), PASSED_OVER, "W", 5)


@query(
    "win04_period_terms",
    f"""WITH {KEYWORDED}, cells AS (SELECT CAST(CAST(d.ts AS DATE) AS VARCHAR) AS period, keyword AS topic FROM docs d JOIN keywords USING (id) WHERE ts IS NOT NULL),
counted AS (SELECT period, topic, count(*) AS n FROM cells GROUP BY 1, 2)
SELECT period, CAST(row_number() OVER (PARTITION BY period ORDER BY n DESC, topic) AS INTEGER) AS rank, topic, n FROM counted
QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, topic) <= 3""",
)
def period_terms(spark, d):
    docs = keyworded(spark, d).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return temporal.top_topics(docs, PASSED_OVER, "D", 3, "keywords")


@query("agg20_document_counts", f"WITH {DOCS} SELECT {WEEK.format('ts')} AS period, count(*) AS document_count FROM docs WHERE ts IS NOT NULL GROUP BY 1")
def document_counts(spark, d):
    return temporal.with_label(temporal.document_counts(documents(spark, d), "W"), "W")


@query(
    "fea10_linked_outcome",
    f"""WITH {NEAREST}, votes AS (
  SELECT n.row_id, CAST(d.n_chars AS DOUBLE) AS value, count(*) AS c, min(d.num) AS first_id FROM nearest n JOIN docs d ON d.id = n.doc_id GROUP BY 1, 2),
best AS (SELECT row_id, value FROM votes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY c DESC, first_id) = 1)
SELECT b.value AS outcome FROM best b JOIN event_rows e USING (row_id)""",
)
def linked_outcome(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    links = linkage.link_by_nearest_time(docs, rows)
    return fea.linked_xy(docs, rows.select("row_id", "value", "k", "event_type"), links, "n_chars")[1]


@query(
    "fea10_linked_features",
    f"""WITH {NEAREST}, linked AS (SELECT DISTINCT row_id FROM nearest)
SELECT row_id, value, k, CAST(event_type = 'error' AS INTEGER) AS event_type_error, CAST(event_type = 'purchase' AS INTEGER) AS event_type_purchase,
  CAST(event_type = 'signup' AS INTEGER) AS event_type_signup, CAST(event_type = 'view' AS INTEGER) AS event_type_view
FROM event_rows JOIN linked USING (row_id)""",
)
def linked_features(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    links = linkage.link_by_nearest_time(docs, rows)
    return fea.linked_xy(docs, rows.select("row_id", "value", "k", "event_type"), links, "n_chars")[0]


# -- frames that models get through each kind of link --------------------------------------------------------------

LANGUAGES = "classes AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS class FROM (SELECT DISTINCT value FROM best))"
FRAME = "SELECT e.row_id, e.value, e.k, CAST(c.class AS DOUBLE) AS lang FROM best b JOIN classes c USING (value) JOIN event_rows e ON e.row_id = b.row_id WHERE e.value IS NOT NULL AND e.k IS NOT NULL"


def linked_frame(spark, d, links):
    return fea.linked_frame(documents(spark, d), event_rows(spark, d), links, "lang", ["value", "k"])[0]


@query(
    "fea10_frame_by_id",
    f"""WITH {DOCS}, {EVENT_ROWS}, best AS (SELECT e.row_id, d.lang AS value FROM event_rows e JOIN docs d ON d.id = CAST(e.user_id AS VARCHAR)), {LANGUAGES} {FRAME}""",
)
def frame_by_id(spark, d):
    return linked_frame(spark, d, linkage.link_by_id(documents(spark, d), event_rows(spark, d), "user_id"))


@query(
    "fea10_frame_by_nearest_time",
    f"""WITH {NEAREST}, votes AS (SELECT n.row_id, d.lang AS value, count(*) AS c, min(d.num) AS first_id FROM nearest n JOIN docs d ON d.id = n.doc_id GROUP BY 1, 2),
best AS (SELECT row_id, value FROM votes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY c DESC, first_id) = 1), {LANGUAGES} {FRAME}""",
)
def frame_by_nearest_time(spark, d):
    return linked_frame(spark, d, linkage.link_by_nearest_time(documents(spark, d), event_rows(spark, d)))


def _by_period(spark, d):
    return linkage.link_by_period(documents(spark, d), event_rows(spark, d), period="D")


@query(
    "fea10_frame_by_period",
    f"""WITH {DOCS}, {EVENT_ROWS}, votes AS (SELECT CAST(ts AS DATE) AS day, lang AS value, count(*) AS c, min(num) AS first_id FROM docs WHERE ts IS NOT NULL GROUP BY 1, 2),
daily AS (SELECT day, value FROM votes QUALIFY row_number() OVER (PARTITION BY day ORDER BY c DESC, first_id) = 1),
best AS (SELECT e.row_id, y.value FROM event_rows e JOIN daily y ON y.day = CAST(e.ts AS DATE)), {LANGUAGES} {FRAME}""",
)
def frame_by_period(spark, d):
    return linked_frame(spark, d, _by_period(spark, d))


def _talks(spark, d):
    """Conversation turns as rows with numbers and a text that holds keywords."""
    t = table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "turn", F.length("text").alias("size"), "text")


def _by_keyword(spark, d):
    words = keyworded(spark, d).select(F.col("id").alias("doc_id"), F.explode("keywords").alias("keyword"))
    return linkage.link_by_keyword(words, _talks(spark, d), "text")


@query(
    "fea10_frame_by_keyword",
    f"""WITH {KEYWORDED}, talks AS (SELECT conv_id * 1000 + turn AS row_id, turn, CAST(length(text) AS INTEGER) AS size, text FROM conversations),
tw AS (SELECT DISTINCT row_id, unnest({sql_words('text')}) AS keyword FROM talks),
votes AS (SELECT tw.row_id, d.n_chars AS value, count(*) AS c, min(d.num) AS first_id FROM tw JOIN keywords k USING (keyword) JOIN docs d ON d.id = k.id GROUP BY 1, 2),
best AS (SELECT row_id, sum(CAST(value AS DOUBLE) * c) / sum(c) AS value FROM votes GROUP BY 1)
SELECT t.row_id, t.turn, t.size, round(b.value, 6) AS n_chars FROM talks t JOIN best b USING (row_id) WHERE t.turn IS NOT NULL AND t.size IS NOT NULL""",
)
def frame_by_keyword(spark, d):
    frame, _ = fea.linked_frame(documents(spark, d), _talks(spark, d), _by_keyword(spark, d), "n_chars", ["turn", "size"], "mean")
    return frame.withColumn("n_chars", F.round("n_chars", 6))


def _by_embedding(spark, d):
    rows = linkage.numeric_vectors(event_rows(spark, d), ["value", "user_id", "k"])
    return linkage.link_by_embedding(_text_vectors(spark, d), rows, top_k=3, threshold=0.2)


@query("fea10_frame_by_embedding")
def frame_by_embedding(spark, d):
    return linked_frame(spark, d, _by_embedding(spark, d))


@query("ml01_clusters_of_rows_linked_by_id")
def linked_clusters(spark, d):
    """Centres and inertia of the linked rows."""
    links = linkage.link_by_id(documents(spark, d), event_rows(spark, d), "user_id")
    _, centres, inertia = ml.through_links(ml.kmeans, documents(spark, d), event_rows(spark, d), links, "lang", ["value", "k"], clusters=3)
    return centres.withColumn("inertia", F.lit(float(inertia)))


@query("ml03_svm_by_period_links")
def linked_svm(spark, d):
    return ml.through_links(ml.linear_svm, documents(spark, d), event_rows(spark, d), _by_period(spark, d), "lang", ["value", "k", "event_type"], "first").scores


@query("ml05_forest_by_nearest_time")
def linked_forest(spark, d):
    docs, rows = documents(spark, d), event_rows(spark, d)
    links = linkage.link_by_nearest_time(docs, rows)
    found, held_out = ml.through_links(ml.random_forest, docs, rows, links, "source", ["value", "k", "event_type"], trees=20)
    return found.scores


@query("ml09_regression_by_keyword_links")
def linked_regression(spark, d):
    kind, coefficients, fit = ml.through_links(ml.regression, documents(spark, d), _talks(spark, d), _by_keyword(spark, d), "n_chars", ["turn", "size"], "mean")
    return coefficients.withColumn("kind", F.lit(kind))


@query("ml02_net_by_embedding_links")
def linked_net(spark, d):
    made = ml.through_links(ml.neural_net, documents(spark, d), event_rows(spark, d), _by_embedding(spark, d), "lang", ["value", "k"], iterations=10)
    return ml.accuracy(made[1])


# -- replays of a table as a stream --------------------------------------------------------------------------------

# periods that end before the last document's time less the watermark's delay of a day
PASSED = "{0} + {1} <= (SELECT max(ts) FROM docs) - INTERVAL 1 DAY"


@query(
    "agg03_streamed_topics",
    f"""WITH {DOCS}, cells AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS period_start, unnest({sql_white('text')}) AS topic FROM docs WHERE ts IS NOT NULL),
counted AS (SELECT period_start, topic, count(*) AS n FROM cells WHERE length(topic) > 3 AND topic NOT IN ({STOPS}) GROUP BY 1, 2)
SELECT period_start, CAST(row_number() OVER (PARTITION BY period_start ORDER BY n DESC, topic) AS INTEGER) AS rank, topic, n FROM counted
WHERE {PASSED.format('period_start', 'INTERVAL 7 DAY')}
QUALIFY row_number() OVER (PARTITION BY period_start ORDER BY n DESC, topic) <= 5""",
)
def streamed_topics(spark, d):
    folder = new_folder(spark, "streamed-topics")
    counts = windows.topic_count_stream(document_stream(spark, d), PASSED_OVER, "W")
    windows.write_top_topics(counts, folder, new_folder(spark, "stream-state"), 5).awaitTermination()
    return windows.read_top_topics(spark, folder)


@query(
    "agg02_streamed_sentiment",
    f"""WITH {DOCS}, scored AS (
  SELECT CAST(ts AS DATE) AS period_start, ts, CAST(CASE WHEN quality = 1 THEN 1 WHEN toxic = 1 THEN -1 ELSE 0 END AS DOUBLE) AS s
  FROM docs JOIN labels ON num = doc_id WHERE ts IS NOT NULL)
SELECT period_start, round(avg(s), 6) AS mean, median(s) AS median, min(s) AS min, max(s) AS max, count(*) AS document_count FROM scored
WHERE {PASSED.format('period_start', 'INTERVAL 1 DAY').replace('docs', 'scored')} GROUP BY period_start""",
)
def streamed_sentiment(spark, d):
    folder = new_folder(spark, "streamed-sentiment")
    trend = windows.sentiment_stream(_labelled(spark, d, document_stream(spark, d)), "D")
    writer = trend.writeStream.format("parquet").option("path", folder).option("checkpointLocation", new_folder(spark, "stream-state"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(trend.schema).parquet(folder).withColumn("mean", F.round("mean", 6))
