"""Inputs of the registered queries, once as DataFrames and once as SQL text over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.text import token_counts, words
from textweave.session import apply_settings
from textweave.sources.ingest import as_documents, spread_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where plain SQL can state the same result, its SQL."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(apply_settings(spark), folder)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Tables whose records are texts, and a key to spread them by.
TEXTS = {"documents": "doc_id", "pages": "page_id", "benchmark": "item_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_scan(df, TEXTS[name]) if name in TEXTS else df


# -- documents -----------------------------------------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a derived time (missing for every 50th) and metadata lang, source, n_chars."""
    return documents_of(table(spark, folder, "documents"))


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same read as a stream of files."""
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    # a pattern, because a stream takes a plain path for a directory and the table may be one file
    return documents_of(spark.readStream.schema(schema).parquet(f"{folder}/{{documents}}.parquet"))


def documents_of(raw: DataFrame) -> DataFrame:
    minutes = (F.col("doc_id") * 37) % 43200
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    return as_documents(
        raw, F.col("doc_id"), F.col("text"), F.when(F.col("doc_id") % 50 != 0, ts),
        F.create_map(
            F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string")
        ),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")),
    )


DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS num, source || '-' || CAST(doc_id AS VARCHAR) || '.txt' AS name,
         text, lang, source, n_chars,
         CASE WHEN doc_id % 50 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 37) % 43200 AS INTEGER)) END AS ts
  FROM documents)"""


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as numeric rows: row_id, ts, user_id, event_type, value, k."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_id").alias("row_id"), "ts", "user_id", "event_type", "value", k.alias("k"))


EVENT_ROWS = """event_rows AS (
  SELECT event_id AS row_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""


def dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events with gaps: value missing for every 11th, event_type empty for every 13th."""
    e = event_rows(spark, folder)
    return e.withColumn("value", F.when(F.col("row_id") % 11 != 0, F.col("value"))).withColumn(
        "event_type", F.when(F.col("row_id") % 13 == 0, "").otherwise(F.col("event_type"))
    )


DIRTY_ROWS = EVENT_ROWS + """, dirty AS (
  SELECT row_id, ts, user_id, CASE WHEN row_id % 13 = 0 THEN '' ELSE event_type END AS event_type,
         CASE WHEN row_id % 11 <> 0 THEN value END AS value, k
  FROM event_rows)"""


def label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as rows that share the documents' ids."""
    return table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("id"), "quality", "toxic")


# -- tokens --------------------------------------------------------------------------------------------------------

WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_white(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{WHITE}'), lambda x: x <> '')"


def sql_sentences(text: str) -> str:
    return (
        f"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
    )


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(form, lemma, pos, valence) for every word of the documents, from the length of the word."""
    forms = table(spark, folder, "documents").select(F.explode(words("text")).alias("form")).distinct()
    n = F.length("form")
    lemma = F.when(n > 1, F.regexp_replace("form", "s$", "")).otherwise(F.col("form"))
    tag = F.when(n % 4 == 0, "NOUN").when(n % 4 == 1, "VERB").when(n % 4 == 2, "ADJ").otherwise("ADV")
    return forms.select("form", lemma.alias("lemma"), tag.alias("pos"), (n % 5 - 2).cast("double").alias("valence"))


TOKENS = DOCS + f""", sent_lists AS (
  SELECT id AS doc_id, {sql_sentences('text')} AS ss FROM docs),
sents AS (
  SELECT doc_id, i - 1 AS sent, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sent_lists)),
form_lists AS (
  SELECT doc_id, sent, {sql_words('sentence')} AS fs FROM sents),
forms AS (
  SELECT doc_id, sent, j - 1 AS pos, fs[j] AS form FROM (SELECT doc_id, sent, fs, unnest(range(1, len(fs) + 1)) AS j FROM form_lists)),
tokens AS (
  SELECT doc_id, sent, pos, form,
         CASE WHEN length(form) > 1 THEN regexp_replace(form, 's$', '') ELSE form END AS lemma,
         CASE length(form) % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' ELSE 'ADV' END AS tag
  FROM forms)"""

WHITE_TERMS = DOCS + f""", terms AS (
  SELECT id AS doc_id, num, ts, unnest({sql_white('text')}) AS term FROM docs)"""


def keyworded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their three commonest words as ``keywords`` and the language as cluster."""
    docs = documents(spark, folder)
    ranked = F.array_sort(F.transform(token_counts(words("text")), lambda c: F.struct((-c["n"]).alias("less"), c["token"].alias("w"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda c: c["w"])
    cluster = F.map_concat("metadata", F.create_map(F.lit("cluster"), F.try_element_at("metadata", F.lit("lang"))))
    return docs.withColumn("keywords", F.when(F.size(top) > 0, top)).withColumn("metadata", cluster)


KEYWORDED = DOCS + f""", word_list AS (
  SELECT id, unnest({sql_words('text')}) AS w FROM docs),
doc_words AS (
  SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, w) AS r FROM word_list GROUP BY id, w),
keywords AS (SELECT id, w AS keyword, r FROM doc_words WHERE r <= 3)"""


def flat(properties: str = "properties"):
    """Property map as text, keys in order, so that both engines can be compared."""
    entries = F.array_sort(F.map_entries(properties))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
