"""Queries: topic models and MLlib jobs. Most have no SQL counterpart; their invariants are tested."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from textweave.operators import linkage, ml, stats, topics

from textweave.registry.frames import (
    DOCS,
    documents,
    event_rows,
    label_rows,
    query,
    sql_words,
    table,
)
from textweave.registry.text_queries import word_lists

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, d):
    """Line items with a key of their own."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    return table(spark, d, "lineitem").select(key, *NUMBERS, F.col("l_suppkey").alias("supplier"), "l_returnflag", "l_linestatus")


@cache
def _fitted(spark, d):
    """Topic model shared by the topic queries of one session."""
    return topics.fit_topics(word_lists(spark, d), topics=8, passes=15)


def _index(spark, d):
    return documents(spark, d).select(F.col("id").alias("doc_id"), F.col("id").cast("bigint").alias("position"))


# -- topics --------------------------------------------------------------------------------------------------------


@query("top01_topic_words")
def topic_words(spark, d):
    return topics.topic_words(_fitted(spark, d), 8)


@query("top02_document_topics")
def document_topics(spark, d):
    return topics.document_topics(_fitted(spark, d).scored)


@query("top03_log_perplexity")
def log_perplexity(spark, d):
    value = _fitted(spark, d).log_perplexity
    return documents(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.lit(float(value)).alias("log_perplexity"))


FIXED = [("t0", 1, "the"), ("t0", 2, "of"), ("t0", 3, "and"), ("t0", 4, "that"), ("t1", 1, "de"), ("t1", 2, "la"), ("t1", 3, "en"), ("t1", 4, "der")]
FIXED_SQL = ", ".join(f"('{t}', {r}, '{w}')" for t, r, w in FIXED)


# windows, words and pairs of the fixed topics, as counts of window starts
WINDOWS = f"""tw(topic, rank, word) AS (VALUES {FIXED_SQL}), lists AS (SELECT doc_id, {sql_words('text')} AS ws FROM documents),
sized AS (SELECT doc_id, ws, len(ws) AS n, greatest(len(ws) - 110, 0) AS last FROM lists WHERE len(ws) > 0),
total AS (SELECT sum(last + 1) AS windows FROM sized),
cells AS (SELECT doc_id, last, unnest(range(0, n)) AS pos, unnest(ws) AS word FROM sized),
starts AS (SELECT DISTINCT topic, doc_id, word, unnest(range(greatest(pos - 109, 0), least(pos, last) + 1)) AS start FROM cells JOIN tw USING (word)),
single AS (SELECT topic, word, count(*) AS n FROM starts GROUP BY 1, 2),
pair AS (SELECT a.topic, a.word AS a, b.word AS b, count(*) AS c FROM starts a JOIN starts b ON a.topic = b.topic AND a.doc_id = b.doc_id AND a.start = b.start GROUP BY 1, 2, 3),
wanted AS (SELECT x.topic, x.word AS a, y.word AS b, x.rank AS ra, y.rank AS rb FROM tw x JOIN tw y ON x.topic = y.topic),
joined AS (SELECT w.*, coalesce(p.c, 0) / CAST(windows AS DOUBLE) + 1e-12 AS j, coalesce(s.n, 0) / CAST(windows AS DOUBLE) AS pa, coalesce(t.n, 0) / CAST(windows AS DOUBLE) AS pb
  FROM wanted w LEFT JOIN pair p ON p.topic = w.topic AND p.a = w.a AND p.b = w.b LEFT JOIN single s ON s.topic = w.topic AND s.word = w.a LEFT JOIN single t ON t.topic = w.topic AND t.word = w.b, total),
npmi AS (SELECT topic, a, b, ra, rb, CASE WHEN pa = 0 OR pb = 0 THEN 0 ELSE ln(j / (pa * pb)) / -ln(j) END AS m FROM joined)"""


def _fixed(spark):
    return spark.createDataFrame(FIXED, "topic string, rank int, word string")


@query("top03_coherence", f"WITH {WINDOWS} SELECT topic, round(avg(m), 6) AS npmi FROM npmi WHERE ra < rb GROUP BY topic")
def coherence(spark, d):
    return topics.coherence(_fixed(spark), word_lists(spark, d)).withColumn("npmi", F.round("npmi", 6))


@query(
    "top03_coherence_cv",
    f"""WITH {WINDOWS}, whole AS (SELECT topic, b, sum(m) AS v FROM npmi GROUP BY 1, 2),
angles AS (SELECT n.topic, n.a, sum(m * v) / (sqrt(sum(m * m)) * sqrt(sum(v * v))) AS c FROM npmi n JOIN whole w ON w.topic = n.topic AND w.b = n.b GROUP BY 1, 2)
SELECT topic, round(avg(c), 6) AS c_v FROM angles GROUP BY topic""",
)
def coherence_cv(spark, d):
    return topics.coherence_cv(_fixed(spark), word_lists(spark, d)).withColumn("c_v", F.round("c_v", 6))


@query("top03_fitted_coherence_cv")
def fitted_coherence_cv(spark, d):
    """Of the fitted topics, by their twenty heaviest words."""
    return topics.coherence_cv(topics.topic_words(_fitted(spark, d), 20), word_lists(spark, d))


@query("top04_document_vectors")
def document_vectors(spark, d):
    return topics.document_vectors(word_lists(spark, d)).select("doc_id", "x", "y", "cluster")


@query("top05_token_topics")
def token_topics(spark, d):
    return topics.token_topics(_fitted(spark, d), _index(spark, d), 0, 10)


@query("top06_well_separated")
def well_separated(spark, d):
    return topics.well_separated(_fitted(spark, d).scored)


@query("win01_dominant_topics")
def dominant_topics(spark, d):
    fitted = _fitted(spark, d)
    return topics.dominant_topics(fitted.scored, topics.topic_words(fitted, 10))


@query(
    "win02_representative",
    f"WITH {DOCS} SELECT lang AS topic, CAST(n_chars AS DOUBLE) AS weight, id AS doc_id FROM docs QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, id) = 1",
)
def representative(spark, d):
    given = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("topic"), F.col("n_chars").cast("double").alias("weight")
    )
    return topics.representative_documents(given)


@query("win03_topics_of_slice")
def topics_of_slice(spark, d):
    return topics.topics_of_slice(_fitted(spark, d).scored, _index(spark, d), 0, 20).select("position", "doc_id", "topic")


@query("agg14_discussed_topics")
def discussed_topics(spark, d):
    fitted = _fitted(spark, d)
    return topics.discussed_topics(fitted.scored, topics.topic_words(fitted, 8))


@query(
    "jn12_word_importance",
    f"""WITH tw(topic, rank, word) AS (VALUES {FIXED_SQL}), cells AS (SELECT unnest({sql_words('text')}) AS word FROM documents),
counted AS (SELECT word, count(*) AS n FROM cells GROUP BY word)
SELECT topic, word, CAST(rank AS DOUBLE) AS weight, coalesce(n, 0) AS word_count FROM tw LEFT JOIN counted USING (word)""",
)
def word_importance(spark, d):
    words = spark.createDataFrame(FIXED, "topic string, rank int, word string").withColumn("weight", F.col("rank").cast("double"))
    return topics.word_importance(words, word_lists(spark, d))


# document weights that SQL can repeat: one per language, from the length and the number of the document
GIVEN = """given AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, n_chars % 7 + 1 AS a, doc_id % 5 + 1 AS b, n_chars % 3 + 1 AS c FROM documents),
weights AS (SELECT doc_id, a / CAST(a + b + c AS DOUBLE) AS w0, b / CAST(a + b + c AS DOUBLE) AS w1, c / CAST(a + b + c AS DOUBLE) AS w2 FROM given),
main AS (SELECT doc_id, CAST(CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS INTEGER) AS topic, round(greatest(w0, w1, w2), 4) AS weight, greatest(w0, w1, w2) AS exact FROM weights)"""


def _given_weights(spark, d):
    a, b, c = F.col("n_chars") % 7 + 1, F.col("doc_id") % 5 + 1, F.col("n_chars") % 3 + 1
    parts = F.array(*[(x / (a + b + c).cast("double")) for x in (a, b, c)])
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), parts.alias("weights"))


@query("win01_dominant_of_given_weights", f"WITH {GIVEN} SELECT doc_id, topic, weight FROM main")
def dominant_given(spark, d):
    return topics.dominant_topics(_given_weights(spark, d))


@query("top06_well_separated_given_weights", f"WITH {GIVEN} SELECT doc_id, topic, weight FROM main WHERE exact > 0.35")
def separated_given(spark, d):
    return topics.well_separated(_given_weights(spark, d))


@query(
    "top02_topics_of_given_weights",
    f"""WITH {GIVEN} SELECT doc_id, topic, round(weight, 9) AS weight FROM (
  SELECT doc_id, CAST(0 AS INTEGER) AS topic, w0 AS weight FROM weights UNION ALL SELECT doc_id, 1, w1 FROM weights UNION ALL SELECT doc_id, 2, w2 FROM weights) WHERE weight >= 0.2501""",
)
def topics_given(spark, d):
    return topics.document_topics(_given_weights(spark, d), 0.2501).withColumn("weight", F.round("weight", 9))


@query(
    "win03_slice_of_given_weights",
    f"""WITH {GIVEN} SELECT CAST(doc_id AS BIGINT) AS position, doc_id, topic, round(w0, 9) AS w0, round(w1, 9) AS w1, round(w2, 9) AS w2
FROM main JOIN weights USING (doc_id) WHERE CAST(doc_id AS BIGINT) BETWEEN 100 AND 199""",
)
def slice_given(spark, d):
    found = topics.topics_of_slice(_given_weights(spark, d), _index(spark, d), 100, 200)
    return found.select("position", "doc_id", "topic", *[F.round(F.col("weights")[i], 9).alias(f"w{i}") for i in range(3)])


@query(
    "agg14_discussed_given_weights",
    f"""WITH {GIVEN}, long AS (SELECT 0 AS topic, w0 AS w FROM weights UNION ALL SELECT 1, w1 FROM weights UNION ALL SELECT 2, w2 FROM weights),
summed AS (SELECT topic, sum(w) AS s FROM long GROUP BY topic), counted AS (SELECT topic, count(*) AS n FROM main GROUP BY topic)
SELECT CAST(s.topic AS INTEGER) AS topic, coalesce(n, 0) AS documents, round(s, 6) AS total_weight, CASE s.topic WHEN 0 THEN 'the, of' WHEN 1 THEN 'de, la' END AS words FROM summed s LEFT JOIN counted c USING (topic)""",
)
def discussed_given(spark, d):
    listed = [(0, 1, "the"), (0, 2, "of"), (1, 1, "de"), (1, 2, "la")]
    words = spark.createDataFrame(listed, "topic int, rank int, word string")
    return topics.discussed_topics(_given_weights(spark, d), words).withColumn("total_weight", F.round("total_weight", 6))


# -- vectors -------------------------------------------------------------------------------------------------------


def _given_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))


@query("sem06_coordinates")
def coordinates(spark, d):
    rows = linkage.numeric_vectors(event_rows(spark, d), ["value", "user_id", "k"])
    texts, numbers = linkage.common_space(_given_vectors(spark, d), rows)
    both = texts.select("doc_id", F.lit("text").alias("side"), "vec").unionByName(
        numbers.select(F.col("row_id").cast("string").alias("doc_id"), F.lit("row").alias("side"), "vec")
    )
    flat = linkage.project(both, "vec", 2)
    return flat.select("doc_id", "side", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


@query(
    "sem06_coordinates_of_given_vectors",
    """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) / 2 AS t FROM v),
axes AS (SELECT ma, mb, cos(t) * s1 AS xa, sin(t) * s1 AS xb, -sin(t) * s2 AS ya, cos(t) * s2 AS yb FROM (
  SELECT *, CASE WHEN (CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END) < 0 THEN -1 ELSE 1 END AS s1,
    CASE WHEN (CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN -sin(t) ELSE cos(t) END) < 0 THEN -1 ELSE 1 END AS s2 FROM m))
SELECT doc_id, round((a - ma) * xa + (b - mb) * xb, 6) AS x, round((a - ma) * ya + (b - mb) * yb, 6) AS y FROM v, axes""",
)
def coordinates_given(spark, d):
    """In the plane the axes follow from one angle."""
    flat = linkage.project(_given_vectors(spark, d).withColumn("vec", F.slice("vec", 1, 2)), "vec", 2)
    return flat.select("doc_id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


@query("sem07_nearest_in_common_space")
def similar_rows(spark, d):
    rows = linkage.numeric_vectors(event_rows(spark, d), ["value", "user_id", "k"])
    texts, numbers = linkage.common_space(_given_vectors(spark, d), rows)
    return linkage.top_similar(texts, numbers, 5, "doc_id", "row_id", "euclidean")


# -- models --------------------------------------------------------------------------------------------------------


@query("ml01_kmeans")
def kmeans(spark, d):
    labelled, _, _ = ml.kmeans(_lines(spark, d), NUMBERS, 3)
    return stats.cluster_profile(labelled, "metadata_cluster", NUMBERS)


@query("ml02_neural_net")
def neural_net(spark, d):
    return ml.accuracy(ml.neural_net(_lines(spark, d), NUMBERS, "l_returnflag", iterations=30)[1])


@query("ml03_linear_svm")
def linear_svm(spark, d):
    return ml.linear_svm(_lines(spark, d), NUMBERS, "l_linestatus").scores


@query(
    "ml04_nearest_rows",
    """WITH p AS (SELECT o_totalprice AS t, o_custkey AS c FROM orders WHERE o_orderkey = 3)
SELECT o_orderkey, round(sqrt((o_totalprice - t) * (o_totalprice - t) + (o_custkey - c) * (o_custkey - c)), 6) AS distance FROM orders, p ORDER BY distance, o_orderkey LIMIT 3""",
)
def nearest_rows(spark, d):
    return ml.nearest_rows(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], 3, 3, "o_orderkey").withColumn("distance", F.round("distance", 6))


@query("ml05_random_forest")
def random_forest(spark, d):
    return ml.random_forest(_lines(spark, d), NUMBERS, "l_linestatus")[0].scores


@query("ml05_permutation_importance")
def permutation_importance(spark, d):
    classified, held_out = ml.random_forest(_lines(spark, d), NUMBERS, "l_linestatus")
    return ml.top_features(ml.permutation_importance(classified, held_out, NUMBERS), 5)


@query("ml06_gradient_boosting")
def gradient_boosting(spark, d):
    flagged = _lines(spark, d).withColumn("shipped", (F.col("l_linestatus") == "F").cast("int"))
    return ml.gradient_boosting(flagged, NUMBERS, "shipped").scores


@query("ml08_components")
def components(spark, d):
    return ml.principal_components(_lines(spark, d), NUMBERS, 3).values


@query("win07_cumulative_variance")
def cumulative(spark, d):
    return ml.principal_components(_lines(spark, d), NUMBERS, 3).values.select("component", "cumulative")


# two standardised columns have the eigenvalues 1 + |r| and 1 - |r|, times n / (n - 1)
TWO = """r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, count(*) / CAST(count(*) - 1 AS DOUBLE) AS s FROM lineitem),
two AS (SELECT 1 AS component, (1 + r) * s AS eigenvalue, (1 + r) * 50 AS percent, (1 + r) * 50 AS cumulative FROM r UNION ALL SELECT 2, (1 - r) * s, (1 - r) * 50, 100 FROM r)"""


def _two_components(spark, d):
    found = ml.principal_components(_lines(spark, d), NUMBERS[:2], 2).values
    return found.select("component", *[F.round(c, 6).alias(c) for c in ("eigenvalue", "percent", "cumulative")])


@query("ml08_two_components", f"WITH {TWO} SELECT component, round(eigenvalue, 6) AS eigenvalue, round(percent, 6) AS percent, round(cumulative, 6) AS cumulative FROM two")
def two_components(spark, d):
    return _two_components(spark, d)


@query("win07_cumulative_of_two", f"WITH {TWO} SELECT component, round(cumulative, 6) AS cumulative FROM two")
def cumulative_of_two(spark, d):
    return _two_components(spark, d).select("component", "cumulative")


@query("ml08_scores")
def component_scores(spark, d):
    return ml.principal_components(_lines(spark, d), NUMBERS, 3).scores


# normal equations of three centred features, solved by Cramer's rule; q, d, t and y stand for the columns in turn
NORMAL = """c AS (SELECT var_pop(q) AS qq, var_pop(d) AS dd, var_pop(t) AS tt, covar_pop(q, d) AS qd, covar_pop(q, t) AS qt, covar_pop(d, t) AS dt,
  covar_pop(q, y) AS qy, covar_pop(d, y) AS dy, covar_pop(t, y) AS ty, avg(q) AS mq, avg(d) AS md, avg(t) AS mt, avg(y) AS my
  FROM (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice AS y FROM lineitem)),
b AS (SELECT *, (qy * (dd * tt - dt * dt) - qd * (dy * tt - dt * ty) + qt * (dy * dt - dd * ty)) / det AS bq,
  (qq * (dy * tt - dt * ty) - qy * (qd * tt - dt * qt) + qt * (qd * ty - dy * qt)) / det AS bd,
  (qq * (dd * ty - dy * dt) - qd * (qd * ty - dy * qt) + qy * (qd * dt - dd * qt)) / det AS bt
  FROM (SELECT *, qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt) AS det FROM c))"""


@query(
    "ml09_linear_regression",
    f"""WITH {NORMAL} SELECT 'l_quantity' AS feature, round(bq, 3) AS coefficient FROM b UNION ALL SELECT 'l_discount', round(bd, 3) FROM b
UNION ALL SELECT 'l_tax', round(bt, 3) FROM b UNION ALL SELECT 'intercept', round(my - bq * mq - bd * md - bt * mt, 3) FROM b""",
)
def linear(spark, d):
    told = ml.regression(_lines(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")[1]
    return told.withColumn("coefficient", F.round("coefficient", 3))


@query("ml09_logistic_regression")
def logistic(spark, d):
    return ml.regression(_lines(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_linestatus")[1]


@query("ml10_text_convergence")
def text_convergence(spark, d):
    aligned = linkage.align_text_outcome(documents(spark, d), label_rows(spark, d), "quality")
    return ml.text_convergence(aligned)
