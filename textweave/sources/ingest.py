"""From files and tables to documents and numeric rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.functions.metadata import file_tag
from textweave.functions.text import remove_words
from textweave.functions.time import parse_timestamp, timestamp_in_text
from textweave.plans.ordering import with_dense_index

# Names looked up, in this order, when no time column is given.
TIME_COLUMN_NAMES = ("timestamp", "datetime", "time", "date", "created_at", "updated_at")
METADATA_PREFIX = "metadata_"


def as_documents(df: DataFrame, doc_id: Column, text: Column, ts: Column, metadata: Column, name: Column | None = None) -> DataFrame:
    """Project any table to the document schema."""
    return df.select(
        doc_id.cast("string").alias("id"),
        (F.lit("") if name is None else name).alias("name"),
        F.lit("").alias("description"),
        F.lit(0.0).alias("score"),
        F.coalesce(text, F.lit("")).alias("text"),
        ts.cast("timestamp_ntz").alias("ts"),
        metadata.alias("metadata"),
    )


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Hand the records of a scan with fewer splits than cores to all cores; larger scans stay as they are.

    Text work is done record by record, so a table in one small file would otherwise keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# -- text files and pages ------------------------------------------------------------------------------------------


def scan_text_folder(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Files named *.txt as (path, content); the first ``max_files`` by path when given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files if max_files is None else files.orderBy("path").limit(max_files)


def files_to_documents(files: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """One document per file: id is the file name, tag and time are mined; bytes that are not UTF-8 are dropped."""
    name = F.regexp_replace("path", r"^.*/", "")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    prepared = files.select("path", name.alias("file_name"), text.alias("raw"))
    return as_documents(
        prepared,
        F.col("file_name"),
        remove_words("raw", ignored),
        timestamp_in_text("raw"),
        F.create_map(
            F.lit("source"), F.col("path"), F.lit("file_name"), F.col("file_name"), F.lit("tag"), file_tag("file_name")
        ),
        F.col("file_name"),
    )


def read_text_folder(spark: SparkSession, path: str, ignored: Sequence[str] = (), max_files: int | None = None) -> DataFrame:
    return files_to_documents(scan_text_folder(spark, path, max_files), ignored)


def pages_to_documents(pages: DataFrame, url: str = "url", body: str = "html", ignored: Sequence[str] = ()) -> DataFrame:
    """Crawled pages as documents: id is the address, the time is mined from the body."""
    return as_documents(
        pages,
        F.col(url),
        remove_words(body, ignored),
        timestamp_in_text(body),
        F.create_map(F.lit("source"), F.col(url)),
        F.col(url),
    )


# -- CSV and column policy -----------------------------------------------------------------------------------------


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere in this library."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, row_id: str | None = "row_id") -> DataFrame:
    """CSV to a numeric frame: bad lines dropped, NaN to null, rows numbered in file order.

    Give ``schema`` for large inputs: inference reads the data once more.
    """
    reader = (
        spark.read.option("header", True)
        .option("mode", "DROPMALFORMED")
        .option("nanValue", "nan")
        .option("columnPruning", False)
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    columns = df.columns
    if row_id is None:
        return nan_to_null(df)
    located = df.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    numbered = with_dense_index(nan_to_null(located), ["_file", "_block", "_line"], row_id)
    return numbered.select(row_id, *columns)


def column_policy(df: DataFrame, ignored: Sequence[str] = (), text_columns: Sequence[str] = (), id_column: str | None = None) -> DataFrame:
    """Drop ignored columns (the id column is one), cast text columns to string, hide metadata_* columns."""
    dropped = set(ignored) | ({id_column} if id_column else set())
    kept = [c for c in df.columns if c not in dropped and not c.startswith(METADATA_PREFIX)]
    return df.select(*[F.col(c).cast("string").alias(c) if c in text_columns else F.col(c) for c in kept])


def rows_to_documents(
    df: DataFrame,
    text_columns: Sequence[str],
    row_id: str = "row_id",
    id_column: str | None = None,
    time_column: str | None = None,
    ignored: Sequence[str] = (),
    source: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Split a table into documents (text columns joined by one space) and rows (the other columns)."""
    present = [c for c in text_columns if c in df.columns]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in present else F.lit("") for c in text_columns]
    time_column = time_column or detect_time_column(df.columns)
    ts = parse_timestamp(time_column) if time_column in df.columns else F.lit(None)
    key = F.col(id_column if id_column and id_column in df.columns else row_id).cast("string")
    documents = as_documents(
        df,
        F.col(row_id),
        remove_words(F.concat_ws(" ", *parts), ignored),
        ts,
        F.create_map(
            F.lit("source"), F.lit(source), F.lit("file_name"), F.lit(source),
            F.lit("row"), F.col(row_id).cast("string"), F.lit("id"), key,
        ),
    )
    rows = df.drop(*present)
    if time_column in rows.columns:
        rows = rows.withColumn(time_column, parse_timestamp(time_column))
    return documents, rows


def detect_time_column(columns: Sequence[str]) -> str | None:
    return next((c for c in TIME_COLUMN_NAMES if c in columns), None)


def infer_date_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    """String columns of which more than ``share`` parse as dates become timestamps (one aggregate pass)."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    hits = df.agg(*[F.avg(parse_timestamp(c).isNotNull().cast("int")).alias(c) for c in texts]).first()
    dates = [c for c in texts if hits[c] is not None and hits[c] > share]
    return df.withColumns({c: parse_timestamp(c) for c in dates}) if dates else df


def ensure_id_column(df: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """Keep an existing id column, else number the rows 0, 1, ... in ``order``."""
    return df if id_column in df.columns else with_dense_index(df, list(order), id_column)


# -- several sources, caps, conversations --------------------------------------------------------------------------


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Frames from several sources as one, columns matched by name, with a ``source`` column."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """Import cap: the first ``n`` records by key."""
    return df.orderBy(key).limit(n)


def conversations_to_documents(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", turns_per_document: int | None = None
) -> DataFrame:
    """One document per conversation: texts in turn order, joined by one space.

    With ``turns_per_document`` (off by default) a longer conversation continues in documents ``<id>#1``, ``<id>#2``, ...
    """
    part = F.floor(F.col(turn) / turns_per_document) if turns_per_document else F.lit(0)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(text, F.lit("")).alias("text"))))
    joined = turns.groupBy(F.col(conversation).alias("conv"), part.alias("part")).agg(
        F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"), F.count(F.lit(1)).alias("turns")
    )
    name = F.when(F.col("part") == 0, F.col("conv").cast("string")).otherwise(F.concat_ws("#", "conv", "part"))
    return as_documents(
        joined, name, F.col("text"), timestamp_in_text("text"),
        F.create_map(F.lit("id"), F.col("conv").cast("string"), F.lit("turns"), F.col("turns").cast("string")),
    )
