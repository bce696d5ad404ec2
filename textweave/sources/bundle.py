"""Saving and loading: corpus bundles, result tables, vector collections."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.corpus import Corpus
from textweave.functions.text import remove_words
from textweave.functions.time import parse_timestamp
from textweave.sources.ingest import read_csv

MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # text formats keep milliseconds only unless told otherwise
MEMBERS = ("documents", "rows", "links", "relationships")
JSON_DOCUMENT = (
    "id string, name string, description string, documents array<struct<id string, name string, description string, "
    "score double, text string, timestamp string, metadata map<string,string>>>"
)


def write_bundle(corpus: Corpus, path: str) -> None:
    """Write each member as Parquet below ``path``."""
    for member in MEMBERS:
        df = getattr(corpus, member)
        if df is not None:
            df.write.parquet(os.path.join(path, member))


def read_bundle(spark: SparkSession, path: str, corpus_id: str = "corpus", members: tuple[str, ...] = MEMBERS) -> Corpus:
    """Corpus from the Parquet members below ``path``; pass ``members`` when some were not written."""
    frames = {m: spark.read.parquet(os.path.join(path, m)) for m in members}
    return Corpus(corpus_id, **frames)


def read_json_documents(spark: SparkSession, path: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Documents of corpus files saved as JSON objects with a ``documents`` list."""
    raw = spark.read.schema(JSON_DOCUMENT).option("multiLine", True).json(path)
    doc = raw.select(F.explode("documents").alias("d")).select("d.*")
    return doc.select(
        "id", "name", "description", F.coalesce("score", F.lit(0.0)).alias("score"),
        remove_words(F.coalesce("text", F.lit("")), ignored).alias("text"),
        parse_timestamp("timestamp").alias("ts"), "metadata",
    )


RELATIONSHIP_LIST = "relationships array<struct<first string, second string, relation string>>"
DOCUMENTS_PER_FILE = 1000


def write_json_bundle(corpus: Corpus, path: str, per_object: int = DOCUMENTS_PER_FILE) -> None:
    """``path``/corpus.json with objects of about ``per_object`` documents each, and the rows as ``path``/corpus_df.csv.

    Every object carries the corpus' id, name and description; its metadata and relationships are in the first one.
    """
    spark = corpus.spark
    docs = corpus.documents.withColumn("timestamp", F.date_format("ts", MICROSECONDS))
    one = F.struct("id", "name", "description", "score", "text", "timestamp", "metadata")
    parts = docs.count() // per_object + 1
    grouped = docs.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part")).agg(F.collect_list(one).alias("documents"))
    relations = [] if corpus.relationships is None else [r.asDict() for r in corpus.relationships.select("first", "second", "relation").collect()]
    about = {**corpus.metadata, "relationships": json.dumps(relations)}
    names = {"id": corpus.id, "name": corpus.name, "description": corpus.description}
    shared = [F.lit(v).cast("string").alias(k) for k, v in names.items()]
    filed = grouped.select(*shared, "documents", F.lit(None).cast("map<string,string>").alias("metadata"))
    head = spark.range(1).select(*shared, F.array().cast(dict(filed.dtypes)["documents"]).alias("documents"),
                                 F.create_map(*[F.lit(str(x)) for pair in about.items() for x in pair]).alias("metadata"))
    # an object may span lines in files that others wrote, so a file holds one
    head.unionByName(filed).write.option("maxRecordsPerFile", 1).json(os.path.join(path, "corpus.json"))
    if corpus.rows is not None:
        write_result(corpus.rows, os.path.join(path, "corpus_df.csv"), "csv")


def read_json_bundle(spark: SparkSession, path: str, ignored: tuple[str, ...] = (), schema=None, row_id: str | None = None) -> Corpus:
    """The whole corpus saved below ``path``: documents, metadata and relationships of ``corpus.json`` (a file or a folder
    of objects), and the rows of ``corpus_df.csv`` beside it where there is one (of ``schema``, else inferred).

    Relationships are a list of the metadata, as objects or as JSON text; other metadata values are kept as text.
    """
    source = os.path.join(path, "corpus.json")
    raw = spark.read.schema("id string, name string, description string, metadata string").option("multiLine", True).json(source)
    first = raw.agg(*[F.first(c, True).alias(c) for c in raw.columns]).first()
    listed = F.coalesce(
        F.from_json("metadata", RELATIONSHIP_LIST)["relationships"],
        F.from_json(F.get_json_object("metadata", "$.relationships"), f"array<{RELATIONSHIP_LIST.split('array<')[1]}"),
    )
    relationships = raw.select(F.explode(listed).alias("r")).select("r.*")
    about = {k: v if isinstance(v, str) else json.dumps(v) for k, v in json.loads(first["metadata"] or "{}").items() if k != "relationships"}
    rows_path = os.path.join(path, "corpus_df.csv")
    rows = read_csv(spark, rows_path, schema, row_id) if _exists(spark, rows_path) else None
    documents = read_json_documents(spark, source, ignored)
    return Corpus(first["id"] or "corpus", documents, rows, None, relationships, first["name"], first["description"], about)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Result table as csv (with header), json records or parquet."""
    if fmt == "csv":
        df.write.option("header", True).option("timestampNTZFormat", MICROSECONDS).csv(path)
    elif fmt == "json":
        df.write.option("timestampNTZFormat", MICROSECONDS).json(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def save_collection(vectors: DataFrame, path: str, model_column: str = "model") -> str:
    """Vector collection (ids, texts, vectors, metadata) as Parquet, one folder per model."""
    vectors.write.partitionBy(model_column).parquet(path)
    return path


def restore_collection(spark: SparkSession, path: str, model: str | None = None, model_column: str = "model") -> DataFrame:
    df = spark.read.parquet(path)
    return df if model is None else df.filter(F.col(model_column) == model)
