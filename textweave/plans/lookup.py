"""Looking up every element of an array column in a table, without taking the arrays apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.plans.lineage import cut_lineage, written
from textweave.plans.skew import ROWS_PER_SALT, salted_join
from textweave.session import ship

ENTRIES = 4_000_000  # entries that every task holds; of a larger table the commonest, the others are joined


def with_lookup(df: DataFrame, column: str, entries: DataFrame, key: str, fields: Sequence[str], most: int | None = None) -> DataFrame:
    """``df`` with an array column per field of ``entries``, as long as ``column`` and null where an element is unknown.

    A null array counts as empty. Of several entries with the same key the smallest counts. Up to ``most`` entries every
    task holds the table and rows stay where they are; beyond that every task holds the commonest elements, only the rare
    ones leave their row for a join, and rows move once to get them back.
    """
    spark = df.sparkSession
    most = ENTRIES if most is None else most
    once = entries.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*fields)).alias("_e"))
    once = cut_lineage(once.select(key, *[F.col(f"_e.{f}").alias(f) for f in fields]))
    ship(spark)
    if once.limit(most + 1).count() > most:
        return _partly_held(df, column, once, key, fields, most)
    held = spark.sparkContext.broadcast(once.toArrow().combine_chunks())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, place = _places(batch.column(column), held.value.column(key))
            found = [pa.ListArray.from_arrays(offsets, _taken(held.value.column(f), place)) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *fields])

    schema = T.StructType([*df.schema.fields, *[T.StructField(f, T.ArrayType(once.schema[f].dataType)) for f in fields]])
    return df.mapInArrow(add, schema)


def _places(lists: pa.Array, known: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """Where each list begins, and the place of every element in ``known``, null if it is not there."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(lists.flatten())
    # the few words of a batch are hashed, the many known ones only pass by
    met = pc.index_in(known.combine_chunks(), coded.dictionary)
    there = np.flatnonzero(np.asarray(pc.is_valid(met)))
    place = np.full(len(coded.dictionary) + 1, -1)
    place[pc.drop_null(met).to_numpy()] = there
    at = place[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)]
    return pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(at, pa.int64(), mask=at < 0)


def _taken(values: pa.ChunkedArray, place: pa.Array) -> pa.Array:
    return values.combine_chunks().take(place)


def _partly_held(df: DataFrame, column: str, entries: DataFrame, key: str, fields: Sequence[str], most: int) -> DataFrame:
    """The look-up in more than ``most`` entries. Elements that occur ``least`` times or more are held, known or not."""
    spark, own = df.sparkSession, df.columns
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "lookup")  # written, so that numbers stay
    counts = rows.select(F.explode(column).alias(key)).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counted = cut_lineage(counts.join(entries.withColumn("_known", F.lit(True)), key, "left"))
    least = _least(counted, most)
    held = spark.sparkContext.broadcast(counted.filter(F.col("_n") >= least).select(key, *fields).toArrow().combine_chunks())

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            offsets, place = _places(lists, held.value.column(key))
            flat = lists.flatten()
            out = np.flatnonzero(np.asarray(pc.and_(pc.is_null(place), pc.is_valid(flat))))
            row = np.searchsorted(offsets.to_numpy(), out, "right") - 1
            pos = (out - offsets.to_numpy()[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(row)), pa.array(pos), flat.take(pa.array(out))], ["_row", "_pos", key])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, place = _places(batch.column(column), held.value.column(key))
            back = batch.column("_back")
            many = pc.fill_null(pc.list_value_length(back), 0).to_numpy(zero_copy_only=False)
            cells = back.flatten()
            mask = np.zeros(len(place), bool)
            mask[np.repeat(offsets.to_numpy()[:-1], many) + pc.struct_field(cells, "_pos").to_numpy()] = True
            found = []
            for f in fields:
                values = _taken(held.value.column(f), place)
                if len(cells):
                    values = pc.replace_with_mask(values, pa.array(mask), pc.struct_field(cells, f))
                found.append(pa.ListArray.from_arrays(offsets, values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *found], [*own, *fields])

    cells = rows.select("_row", column).mapInArrow(rare, T.StructType([T.StructField("_row", T.LongType()), T.StructField("_pos", T.IntegerType()), T.StructField(key, entries.schema[key].dataType)]))
    known = counted.filter((F.col("_n") < least) & F.col("_known")).select(key, *fields)
    met = cells.join(known, key) if least <= ROWS_PER_SALT else salted_join(cells, known, [key], ["_row", "_pos"])
    gathered = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", *fields))).alias("_back"))
    schema = T.StructType([*df.schema.fields, *[T.StructField(f, T.ArrayType(entries.schema[f].dataType)) for f in fields]])
    # the wide rows are not sorted for it, only what comes back is hashed
    return rows.join(gathered.hint("shuffle_hash"), "_row", "left").mapInArrow(add, schema)


def _least(counted: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` elements reach; one number per different count comes to the driver."""
    left, least = most, 1 << 62
    for count, n in sorted(map(tuple, counted.groupBy("_n").count().collect()), reverse=True):
        if n > left:
            break
        left, least = left - n, count
    return least
