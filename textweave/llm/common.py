"""Shared pieces of the training-data operators: tables, words, sized broadcasts, written intermediates."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.session import apply_settings, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The white space of the word rule `[^\x20\x09-\x0D]+`.
WHITE_CHARS = " \t\n\x0b\f\r"
WHITE_PATTERN = r"[ \x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage and, where SQL can state the same result, its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: fn(apply_settings(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def words(text: Column) -> Column:
    """Maximal runs without white space; none for null or blank text."""
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_PATTERN))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to; the cluster's owner sizes it to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read again by whoever needs it, safe from lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def sized_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``most_rows`` rows, unhinted (a shuffled join) beyond that.

    ``df`` should be cheap to count: a written table or an aggregate of one.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_textweave_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="textweave-"), "textweave"), "zip", root, "textweave")
    context.addPyFile(archive)
    context._textweave_shipped = True


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package within the executors' reach."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, each cut before a blank or line end; longer runs stay whole."""
    at = 0
    while len(text) - at > size:
        cut = min((c for c in (text.find(w, at + size) for w in " \n") if c >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
