"""Queries: sources, sinks and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from textweave.corpus import Corpus
from textweave.functions.metadata import file_tag
from textweave.functions.text import remove_words, words
from textweave.functions.time import timestamp_in_text
from textweave.registry.frames import DOCS, EVENT_ROWS, documents, event_rows, query, sql_words, table
from textweave.session import new_folder
from textweave.sources import bundle, ingest

ISO = r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{3})?(?:Z|[+-]\d{2}:\d{2})?)?"
SLASH = r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"


def sql_mined(text: str) -> str:
    other = f"replace(nullif(regexp_extract({text}, '{SLASH}'), ''), '-', '/')"
    year = f"CASE WHEN regexp_matches({other}, '/\\d{{2}}$') THEN left({other}, length({other}) - 2) || CASE WHEN right({other}, 2) >= '69' THEN '19' ELSE '20' END || right({other}, 2) WHEN regexp_matches({other}, '/\\d{{4}}$') THEN {other} END"
    return (
        f"coalesce(try_cast(nullif(regexp_extract({text}, '{ISO}'), '') AS TIMESTAMP), "
        f"try_strptime({year}, '%m/%d/%Y'), try_strptime({year}, '%d/%m/%Y'))"
    )


@query(
    "src01_text_files",
    f"WITH {DOCS} SELECT name AS id, md5(text) AS text_md5, source AS tag, {sql_mined('text')} AS ts FROM docs",
)
def text_files(spark, d):
    docs = documents(spark, d)
    files = docs.select(F.concat(F.lit("/corpus/"), "name").alias("path"), F.col("text").cast("binary").alias("content"))
    out = ingest.files_to_documents(files)
    return out.select("id", F.md5("text").alias("text_md5"), F.try_element_at("metadata", F.lit("tag")).alias("tag"), "ts")


@query(
    "src01_folder_scan",
    """SELECT CAST(doc_id // 50 AS VARCHAR) AS folder, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS text_md5, '_' AS id_end FROM documents GROUP BY doc_id // 50""",
)
def folder_scan(spark, d):
    """Texts written as files, fifty documents each, and scanned as a folder."""
    path = new_folder(spark, "texts")
    texts = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 50).alias("folder"), F.coalesce("text", F.lit("")).alias("text"))
    texts.repartition("folder").sortWithinPartitions("folder", "doc_id").select("folder", "text").write.partitionBy("folder").text(path, compression="none")
    found = ingest.scan_text_folder(spark, path)
    docs = ingest.files_to_documents(found)
    folder = F.regexp_extract(F.try_element_at("metadata", F.lit("source")), "folder=([0-9]+)/", 1)
    return docs.select(folder.alias("folder"), F.md5("text").alias("text_md5"), F.when(F.col("id").endswith(".txt"), "_").alias("id_end"))


@query("src02_csv_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_scan(spark, d):
    events = table(spark, d, "events")
    path = bundle.write_result(events, new_folder(spark, "events-csv"), "csv")
    return ingest.read_csv(spark, path, schema=events.schema, row_id=None)


@query("src03_column_policy", "SELECT event_type, CAST(value AS VARCHAR) AS value FROM events")
def column_policy(spark, d):
    frame = table(spark, d, "events").withColumn("metadata_origin", F.lit("sensor"))
    return ingest.column_policy(frame, ["user_id", "props", "ts"], ["value"], "event_id")


@query(
    "src04_rows_to_documents",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || p_type AS text, 'part.parquet' AS source, CAST(p_partkey AS VARCHAR) AS meta_id FROM part",
)
def rows_to_documents(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "row_id")
    docs, _ = ingest.rows_to_documents(part, ["p_name", "p_type"], source="part.parquet")
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    return docs.select("id", "text", meta("source").alias("source"), meta("id").alias("meta_id"))


@query("src04_remaining_rows", "SELECT p_partkey AS row_id, p_brand, p_size, p_retailprice FROM part")
def remaining_rows(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "row_id")
    return ingest.rows_to_documents(part, ["p_name", "p_type"])[1]


@query(
    "src05_pages_to_documents",
    f"SELECT url AS id, length(html) AS n_chars, {sql_mined('html')} AS ts FROM pages",
)
def pages_to_documents(spark, d):
    docs = ingest.pages_to_documents(table(spark, d, "pages"))
    return docs.select("id", F.length("text").cast("bigint").alias("n_chars"), "ts")


@query(
    "src06_union_sources",
    "SELECT 'customers' AS source, c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT 'suppliers', s_suppkey, s_name, s_acctbal, NULL FROM supplier",
)
def union_sources(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return ingest.union_sources(
        {
            "customers": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")),
            "suppliers": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")),
        }
    )


@query("src07_import_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def import_cap(spark, d):
    return ingest.first_by_key(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query(
    "src08_row_ids",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS record_id FROM orders",
)
def row_ids(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ingest.ensure_id_column(orders, "record_id", ["o_totalprice", "o_orderkey"]).select("o_orderkey", "record_id")


@query(
    "src09_date_inference",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS seen_at, event_type FROM events",
)
def date_inference(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    seen = F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(text)
    return ingest.infer_date_columns(table(spark, d, "events").select("event_id", seen.alias("seen_at"), "event_type"))


@query(
    "src10_time_column",
    "SELECT CAST(event_id AS VARCHAR) AS id, date_trunc('second', ts) AS ts FROM events",
)
def time_column(spark, d):
    frame = table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "event_type"
    )
    docs, _ = ingest.rows_to_documents(frame, ["event_type"])
    return docs.select("id", "ts")


@query(
    "src11_dates_in_text",
    f"""WITH {DOCS}, dated AS (
  SELECT id, 'Recorded on ' || CAST(CAST(ts AS DATE) AS VARCHAR) || '. ' || text AS iso_text,
         'Recorded on ' || strftime(ts, '%m/%d/%Y') || '. ' || text AS us_text FROM docs WHERE ts IS NOT NULL)
SELECT id, {sql_mined('iso_text')} AS iso_time, {sql_mined('us_text')} AS us_time FROM dated""",
)
def dates_in_text(spark, d):
    docs = documents(spark, d).filter(F.col("ts").isNotNull())
    first = F.lit("Recorded on ")
    iso = F.concat(first, F.col("ts").cast("date").cast("string"), F.lit(". "), "text")
    us = F.concat(first, F.date_format("ts", "MM/dd/yyyy"), F.lit(". "), "text")
    return docs.select("id", timestamp_in_text(iso).alias("iso_time"), timestamp_in_text(us).alias("us_time"))


@query(
    "src12_file_tags",
    """SELECT doc_id, source AS dash_tag, source AS under_tag, CAST(NULL AS VARCHAR) AS no_tag, source || '_' || doc_id AS both_tag FROM documents""",
)
def file_tags(spark, d):
    raw = table(spark, d, "documents")
    name = lambda sep: F.concat("source", F.lit(sep), F.col("doc_id").cast("string"), F.lit(".txt"))
    both = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("-part.txt"))
    return raw.select(
        "doc_id", file_tag(name("-")).alias("dash_tag"), file_tag(name("_")).alias("under_tag"),
        file_tag(F.concat("source", F.lit(".txt"))).alias("no_tag"), file_tag(both).alias("both_tag"),
    )


@query(
    "src13_ignored_words",
    f"""WITH lists AS (SELECT doc_id, {sql_words('text')} AS ws FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(ws, lambda w: w NOT IN ('the', 'de', 'und')), ' ')) AS words_md5 FROM lists""",
)
def ignored_words(spark, d):
    cleaned = table(spark, d, "documents").select("doc_id", remove_words("text", ["the", "de", "und"]).alias("text"))
    return cleaned.select("doc_id", F.md5(F.array_join(words("text"), " ")).alias("words_md5"))


@query(
    "src14_bundle_round_trip",
    f"""WITH {DOCS}, {EVENT_ROWS}
SELECT 'documents' AS member, count(*) AS n, count(ts) AS n_dated, CAST(sum(length(text)) AS BIGINT) AS total FROM docs
UNION ALL SELECT 'rows', count(*), count(ts), CAST(sum(k) AS BIGINT) FROM event_rows""",
)
def bundle_round_trip(spark, d):
    path = new_folder(spark, "bundle")
    bundle.write_bundle(Corpus("c", documents(spark, d), event_rows(spark, d)), path)
    back = bundle.read_bundle(spark, path, members=("documents", "rows"))
    one = lambda df, name, total: df.agg(
        F.lit(name).alias("member"), F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_dated"), F.sum(total).cast("bigint").alias("total")
    )
    return one(back.documents, "documents", F.length("text")).unionByName(one(back.rows, "rows", F.col("k")))


@query(
    "src14_json_bundle",
    f"""WITH {DOCS}, {EVENT_ROWS}
SELECT 'documents' AS member, count(*) AS n, count(ts) AS n_dated, CAST(sum(length(text)) AS BIGINT) AS total FROM docs
UNION ALL SELECT 'rows', count(*), count(ts), CAST(sum(k) AS BIGINT) FROM event_rows
UNION ALL SELECT 'relationships', 2, NULL, NULL""",
)
def json_bundle(spark, d):
    """A whole corpus saved as JSON objects with the rows beside them, and read back."""
    path = new_folder(spark, "json-bundle")
    told = spark.createDataFrame([("text:a", "num:value", "correlates"), ("text:b", "num:k", "predicts")], "first string, second string, relation string")
    rows = event_rows(spark, d)
    bundle.write_json_bundle(Corpus("c", documents(spark, d), rows, None, told, "name", None, {"made": "here"}), path)
    back = bundle.read_json_bundle(spark, path, schema=rows.schema)
    one = lambda df, name, dated, total: df.agg(
        F.lit(name).alias("member"), F.count(F.lit(1)).alias("n"), dated.alias("n_dated"), F.sum(total).cast("bigint").alias("total")
    )
    none = F.lit(None).cast("bigint")
    return (
        one(back.documents, "documents", F.count("ts"), F.length("text")).unionByName(one(back.rows, "rows", F.count("ts"), F.col("k")))
        .unionByName(one(back.relationships, "relationships", none, none))
    )


@query(
    "src15_bundle_documents",
    f"WITH {DOCS} SELECT id, name, ts, md5(text) AS text_md5, lang FROM docs",
)
def bundle_documents(spark, d):
    path = new_folder(spark, "bundle")
    bundle.write_bundle(Corpus("c", documents(spark, d), event_rows(spark, d)), path)
    back = bundle.read_bundle(spark, path, members=("documents", "rows")).documents
    return back.select("id", "name", "ts", F.md5("text").alias("text_md5"), F.try_element_at("metadata", F.lit("lang")).alias("lang"))


@query(
    "src16_result_sink",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type",
)
def result_sink(spark, d):
    result = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    path = bundle.write_result(result, new_folder(spark, "result"), "json")
    return spark.read.schema(result.schema).json(path)


@query(
    "src17_document_table",
    f"WITH {DOCS} SELECT id, name, '' AS description, CAST(0 AS DOUBLE) AS score, md5(text) AS text_md5, ts, lang, source FROM docs",
)
def document_table(spark, d):
    from textweave.operators.filters import document_table as as_table

    meta = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return as_table(documents(spark, d)).select("id", "name", "description", "score", F.md5("text").alias("text_md5"), "ts", meta("lang"), meta("source"))


@query(
    "src19_collection_round_trip",
    "SELECT vec_id, label, len(embedding) AS dimensions, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
)
def collection_round_trip(spark, d):
    vectors = table(spark, d, "embeddings").withColumn("model", F.lit("given"))
    path = bundle.save_collection(vectors, new_folder(spark, "collection"))
    back = bundle.restore_collection(spark, path, "given")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return back.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dimensions"), F.round(total, 6).alias("total"))


@query(
    "src21_conversations",
    """SELECT CAST(conv_id AS VARCHAR) AS id, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, count(*) AS turns
FROM conversations GROUP BY conv_id""",
)
def conversations(spark, d):
    docs = ingest.conversations_to_documents(table(spark, d, "conversations"))
    turns = F.try_element_at("metadata", F.lit("turns")).cast("bigint")
    return docs.select("id", F.md5("text").alias("text_md5"), turns.alias("turns"))
