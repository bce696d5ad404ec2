"""Queries: statistics, features, ranks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from textweave.operators import features as fea
from textweave.operators import stats
from textweave.operators.ml import column_itemsets, column_rules, covariance, nearest_rows, simple_regression
from textweave.registry.frames import DIRTY_ROWS, DOCS, dirty_rows, documents, query, sql_white, table

PRICES = ["l_quantity", "l_extendedprice", "l_discount"]


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- description ---------------------------------------------------------------------------------------------------


def _describe_sql(table_name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {table_name}"
        for c in columns
    )


@query("agg04_describe", _describe_sql("lineitem", [*PRICES, "l_tax"]))
def describe(spark, d):
    # in the order of the files: a mean that lies on the edge of its last digit depends on the order of its sum
    return rounded(stats.describe(table(spark, d, "lineitem"), [*PRICES, "l_tax"]), ["mean", "std", "q25", "q50", "q75"])


@query("agg05_distinct_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")))
def distinct_counts(spark, d):
    return stats.distinct_counts(table(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])


@query(
    "agg05_value_counts",
    "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL "
    "SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
)
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query(
    "agg06_metadata_profile",
    f"""WITH {DIRTY_ROWS} SELECT 'metadata_value' AS "column", count(value) AS n_present, count(*) - count(value) AS n_missing, count(DISTINCT value) AS n_distinct FROM dirty
UNION ALL SELECT 'metadata_type', count(nullif(event_type, '')), count(*) - count(nullif(event_type, '')), count(DISTINCT nullif(event_type, '')) FROM dirty""",
)
def metadata_profile(spark, d):
    frame = dirty_rows(spark, d).select("row_id", F.col("value").alias("metadata_value"), F.nullif("event_type", F.lit("")).alias("metadata_type"))
    return stats.metadata_profile(frame)


# -- correlation ---------------------------------------------------------------------------------------------------


def _pearson_sql(table_name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS correlation FROM {table_name}"
        for a, b in combinations(columns, 2)
    )


@query(
    "agg08_pearson_matrix",
    f"WITH u AS ({_pearson_sql('lineitem', PRICES)}) SELECT * FROM u UNION ALL SELECT variable_2, variable_1, correlation FROM u "
    + "".join(f"UNION ALL SELECT '{c}', '{c}', CAST(1 AS DOUBLE) " for c in PRICES),
)
def pearson(spark, d):
    return rounded(stats.correlation_matrix(table(spark, d, "lineitem"), PRICES), ["correlation"])


def _spearman_sql(table_name: str, columns: list[str]) -> str:
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    parts = [
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, round(corr(x, y), 6) AS correlation FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM {table_name} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in combinations(columns, 2)
    ]
    return " UNION ALL ".join(parts)


@query("agg08_spearman", _spearman_sql("lineitem", PRICES))
def spearman(spark, d):
    return rounded(stats.correlation_pairs(table(spark, d, "lineitem"), PRICES, "spearman"), ["correlation"])


def _kendall_sql(table_name: str, columns: list[str]) -> str:
    parts = []
    for a, b in combinations(columns, 2):
        parts.append(
            f"""SELECT '{a}' AS variable_1, '{b}' AS variable_2, round(sum(CAST(p.n * q.n AS DOUBLE) * sign(p.x - q.x) * sign(p.y - q.y))
  / sqrt(sum(CASE WHEN p.x <> q.x THEN CAST(p.n * q.n AS DOUBLE) ELSE 0 END) * sum(CASE WHEN p.y <> q.y THEN CAST(p.n * q.n AS DOUBLE) ELSE 0 END)), 6) AS correlation
FROM (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {table_name} GROUP BY 1, 2) p, (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {table_name} GROUP BY 1, 2) q"""
        )
    return " UNION ALL ".join(parts)


RANKED = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("agg08_kendall", _kendall_sql("customer", RANKED))
def kendall(spark, d):
    return rounded(stats.correlation_pairs(table(spark, d, "customer"), RANKED, "kendall"), ["correlation"])


@query(
    "agg09_significant_pairs",
    f"SELECT * FROM ({_pearson_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])}) WHERE abs(correlation) >= 0.01",
)
def significant(spark, d):
    return rounded(stats.significant_correlations(table(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice"], 0.01), ["correlation"])


@query(
    "win08_average_rank",
    "WITH r AS (SELECT l_quantity AS value, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS avg_rank FROM lineitem) "
    "SELECT value, count(*) AS n, CAST(min(avg_rank) AS DOUBLE) AS avg_rank FROM r GROUP BY value",
)
def average_rank(spark, d):
    return stats.rank_table(table(spark, d, "lineitem"), "l_quantity")


# -- lengths and groups --------------------------------------------------------------------------------------------

LENGTHS = (
    "count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS std, round(quantile_cont(CAST(length(text) AS DOUBLE), 0.01), 6) AS p01, "
    "round(median(CAST(length(text) AS DOUBLE)), 6) AS median, round(quantile_cont(CAST(length(text) AS DOUBLE), 0.99), 6) AS p99"
)
LENGTH_COLUMNS = ["mean", "std", "p01", "median", "p99"]


@query("agg12_length_statistics", f"SELECT {LENGTHS} FROM documents")
def length_statistics(spark, d):
    return rounded(stats.length_statistics(documents(spark, d)), LENGTH_COLUMNS)


@query("agg13_length_by_group", f"SELECT lang, {LENGTHS} FROM documents GROUP BY lang")
def length_by_group(spark, d):
    return rounded(stats.length_statistics(table(spark, d, "documents"), group="lang"), LENGTH_COLUMNS)


def _histogram_sql(group: str | None, bins: int) -> str:
    key, by = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    return f"""WITH l AS (SELECT {key}CAST(length(text) AS DOUBLE) AS len, min(length(text)) OVER ({by}) AS lo, max(length(text)) OVER ({by}) AS hi FROM documents)
SELECT {key}CAST(least(floor((len - lo) / (CAST(hi - lo AS DOUBLE) / {bins})), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM l GROUP BY ALL"""


@query("agg12_length_histogram", _histogram_sql(None, 100))
def histogram(spark, d):
    return stats.length_histogram(documents(spark, d), 100)


@query("agg13_histogram_by_group", _histogram_sql("lang", 20))
def histogram_by_group(spark, d):
    return stats.length_histogram(table(spark, d, "documents"), 20, group="lang")


@query("agg16_cluster_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return stats.cluster_sizes(table(spark, d, "embeddings"), "label")


@query("agg16_cluster_members", "SELECT label, vec_id FROM embeddings")
def cluster_members(spark, d):
    return stats.cluster_members(table(spark, d, "embeddings"), "label", "vec_id")


@query(
    "agg17_cluster_profile",
    "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean_c_acctbal, round(avg(c_nationkey), 6) AS mean_c_nationkey FROM customer GROUP BY 1",
)
def cluster_profile(spark, d):
    return rounded(stats.cluster_profile(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]), ["mean_c_acctbal", "mean_c_nationkey"])


@query(
    "agg17_vector_profile",
    "WITH c AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding) AS x FROM embeddings) "
    "SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM c GROUP BY 1, 2",
)
def vector_profile(spark, d):
    return rounded(stats.array_profile(table(spark, d, "embeddings"), "label", "embedding"), ["mean"])


@query(
    "agg18_confusion",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)
SELECT tp, fp, tn, fn, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision,
  round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1 FROM c""",
)
def confusion(spark, d):
    return rounded(stats.confusion(table(spark, d, "labels"), "quality", "toxic"), ["accuracy", "precision", "recall", "f1"])


@query(
    "agg18_confusion_matrix",
    "SELECT quality AS actual, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1 FROM labels GROUP BY quality",
)
def confusion_matrix(spark, d):
    return stats.confusion_matrix(table(spark, d, "labels"), "quality", "toxic")


@query(
    "agg22_scaler_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std_pop FROM lineitem"
        for c in PRICES
    ),
)
def scaler_statistics(spark, d):
    return rounded(fea.scaler_statistics(table(spark, d, "lineitem"), PRICES), ["mean", "std_pop"])


@query(
    "win06_nearest_rows",
    """WITH p AS (SELECT p_size AS s, p_retailprice AS r FROM part WHERE p_partkey = 3)
SELECT p_partkey, round(sqrt((p_size - s) * (p_size - s) + (p_retailprice - r) * (p_retailprice - r)), 6) AS distance FROM part, p ORDER BY distance, p_partkey LIMIT 10""",
)
def nearest(spark, d):
    return rounded(nearest_rows(table(spark, d, "part"), ["p_size", "p_retailprice"], 3, 10, "p_partkey"), ["distance"])


# -- features ------------------------------------------------------------------------------------------------------


@query(
    "fea01_bin_column",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, CAST(least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 5)) - 1, 0), 4) AS INTEGER) AS o_totalprice FROM orders, s""",
)
def bin_column(spark, d):
    return fea.bin_column(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5)


def _dummies(column: str, levels: list[str]) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS INTEGER) AS \"{column}_{v}\"" for v in levels)


SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("fea02_one_hot", f"SELECT c_custkey, {_dummies('c_mktsegment', SEGMENTS)} FROM customer")
def one_hot(spark, d):
    return fea.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query(
    "fea02_one_hot_sparse",
    """WITH n AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS a, dense_rank() OVER (ORDER BY c_name) AS b FROM customer), s AS (SELECT max(a) AS wa, max(b) AS wb FROM n)
SELECT c_custkey, CAST(wa + wb - 2 AS INTEGER) AS size,
  array_to_string(list_filter([CASE WHEN a > 1 THEN a - 2 END, CASE WHEN b > 1 THEN wa - 1 + b - 2 END], lambda x: x IS NOT NULL), ',') AS indices FROM n, s""",
)
def one_hot_sparse(spark, d):
    """A column of few levels and one with a level for each record."""
    out = fea.one_hot_sparse(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), ["c_mktsegment", "c_name"], "v")
    return out.select("c_custkey", F.col("v.size").alias("size"), F.array_join(F.col("v.indices").cast("array<string>"), ",").alias("indices"))


@query("fea03_one_hot_strings", f"SELECT o_orderkey, {_dummies('o_orderstatus', ['O', 'P'])}, {_dummies('o_orderpriority', PRIORITIES)} FROM orders")
def one_hot_strings(spark, d):
    return fea.one_hot_strings(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("fea04_booleans", "SELECT l_discount <> 0 AS l_discount, l_tax <> 0 AS l_tax, true AS l_returnflag FROM lineitem")
def booleans(spark, d):
    return fea.encode_booleans(table(spark, d, "lineitem").select("l_discount", "l_tax", "l_returnflag"))


@query(
    "fea05_oversample",
    """WITH s AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), m AS (SELECT max(n) AS most FROM s)
SELECT s.toxic, m.most AS n, s.n AS n_originals, CAST(floor(most / n) AS INTEGER) AS least_copies, CAST(ceil(most / CAST(n AS DOUBLE)) AS INTEGER) AS most_copies FROM s, m""",
)
def oversample(spark, d):
    copies = fea.oversample(table(spark, d, "labels"), "toxic", "doc_id").groupBy("toxic", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return copies.groupBy("toxic").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_originals"), F.min("c").cast("int").alias("least_copies"), F.max("c").cast("int").alias("most_copies")
    )


@query(
    "fea06_prepare",
    f"""WITH {DIRTY_ROWS} SELECT row_id, value, CAST(event_type = 'error' AS INTEGER) AS event_type_error, CAST(event_type = 'purchase' AS INTEGER) AS event_type_purchase,
  CAST(event_type = 'signup' AS INTEGER) AS event_type_signup, CAST(event_type = 'view' AS INTEGER) AS event_type_view FROM dirty WHERE value IS NOT NULL AND event_type <> ''""",
)
def prepare(spark, d):
    return fea.prepare(dirty_rows(spark, d).select("row_id", "value", "event_type", "k"), "k")[0]


@query(
    "fea07_min_max",
    "WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS e FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_tax - c) / (e - c), 6) AS l_tax, CAST(0.5 AS DOUBLE) AS one FROM lineitem, s",
)
def min_max(spark, d):
    frame = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(1).alias("one"))
    return rounded(fea.min_max(frame, ["l_quantity", "l_tax", "one"]), ["l_quantity", "l_tax"])


@query(
    "fea08_standardise",
    f"""WITH {DIRTY_ROWS}, m AS (SELECT avg(value) AS v FROM dirty), filled AS (SELECT row_id, coalesce(value, v) AS value, k FROM dirty, m),
s AS (SELECT avg(value) AS a, stddev_pop(value) AS b, avg(k) AS c, stddev_pop(k) AS e FROM filled)
SELECT row_id, round((value - a) / b, 6) + 0.0 AS value, round((k - c) / e, 6) AS k FROM filled, s""",
)
def standardise(spark, d):
    out = rounded(fea.standardise(dirty_rows(spark, d).select("row_id", "value", "k"), ["value", "k"]), ["value", "k"])
    return out.withColumn("value", F.col("value") + 0.0)


@query("fea09_binary_target", "SELECT o_orderkey, CAST(o_orderpriority <> '1-URGENT' AS INTEGER) AS target FROM orders")
def binary_target(spark, d):
    return fea.binary_target(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "target")


@query(
    "fea11_token_sequences",
    f"""WITH {DOCS}, lists AS (SELECT id AS doc_id, {sql_white('text')} AS ws FROM docs),
cells AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS term FROM lists),
vocab AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS ix FROM cells GROUP BY term QUALIFY ix <= 10000),
coded AS (SELECT c.doc_id, c.i, coalesce(v.ix, 0) AS ix FROM cells c LEFT JOIN vocab v USING (term) WHERE c.i <= 100),
listed AS (SELECT doc_id, list(ix ORDER BY i) AS s FROM coded GROUP BY doc_id)
SELECT l.doc_id, 100 AS n, array_to_string(list_concat(coalesce(s, []), [0 for x in range(0, 100 - coalesce(len(s), 0))]), ',') AS sequence FROM lists l LEFT JOIN listed USING (doc_id)""",
)
def token_sequences(spark, d):
    out = fea.token_sequences(documents(spark, d))
    return out.select("doc_id", F.size("sequence").alias("n"), F.array_join(F.transform("sequence", lambda x: x.cast("string")), ",").alias("sequence"))


@query("fea12_split")
def split(spark, d):
    train, test = fea.train_test_split(table(spark, d, "orders"), 0.2, 42, "o_orderkey")
    part = lambda df, name: df.select("o_orderkey", F.lit(name).alias("part"))
    return part(train, "train").unionByName(part(test, "test"))


# -- models that SQL can state -------------------------------------------------------------------------------------

ITEMS = {"discounted": "l_discount <> 0", "taxed": "l_tax <> 0", "large": "l_quantity > 10", "open": "l_linestatus = 'O'"}


def _itemset_sql(least: float) -> str:
    parts = []
    for size in range(1, len(ITEMS) + 1):
        for combo in combinations(sorted(ITEMS), size):
            test = " AND ".join(ITEMS[c] for c in combo)
            parts.append(f"SELECT '{','.join(combo)}' AS items, count(*) FILTER ({test}) AS freq, count(*) AS total FROM lineitem")
    return f"SELECT items, freq, round(freq / CAST(total AS DOUBLE), 6) AS support FROM ({' UNION ALL '.join(parts)}) WHERE freq >= {least} * total"


@query("ml07_itemsets", _itemset_sql(0.3))
def itemsets(spark, d):
    flags = table(spark, d, "lineitem").select(*[F.expr(f"cast({e} as int)").alias(n) for n, e in ITEMS.items()])
    found = column_itemsets(flags, 0.3)
    return found.select(F.array_join("items", ",").alias("items"), "freq", F.round("support", 6).alias("support"))


@query(
    "ml07_rules",
    f"""WITH sets AS ({_itemset_sql(0.3)}), listed AS (SELECT string_split(items, ',') AS s, freq, support FROM sets), total AS (SELECT count(*) AS t FROM lineitem),
taken AS (SELECT s, freq, support, unnest(s) AS consequent FROM listed WHERE len(s) > 1),
rules AS (SELECT list_filter(s, lambda x: x <> consequent) AS a, consequent, freq, support FROM taken)
SELECT array_to_string(r.a, ',') AS antecedent, r.consequent, round(r.support, 6) AS support, round(r.freq / CAST(l.freq AS DOUBLE), 6) AS confidence,
  round(r.freq * CAST(t AS DOUBLE) / (CAST(l.freq AS DOUBLE) * c.freq), 6) AS lift
FROM rules r JOIN listed l ON l.s = r.a JOIN listed c ON c.s = [r.consequent], total WHERE r.freq / CAST(l.freq AS DOUBLE) >= 0.5""",
)
def rules(spark, d):
    flags = table(spark, d, "lineitem").select(*[F.expr(f"cast({e} as int)").alias(n) for n, e in ITEMS.items()])
    out = column_rules(flags, 0.3, 0.5).withColumn("antecedent", F.array_join("antecedent", ","))
    return rounded(out, ["support", "confidence", "lift"])


@query(
    "ml08_covariance",
    "WITH z AS (SELECT "
    + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in PRICES)
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS value FROM z"
        for i, a in enumerate(PRICES) for b in PRICES[i:]
    ),
)
def covariances(spark, d):
    return rounded(covariance(table(spark, d, "lineitem"), PRICES), ["value"])


@query(
    "ml09_simple_regression",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""",
)
def regression_line(spark, d):
    line = simple_regression(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return line.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")
