"""Range and nearest joins on time, planned as equi-joins and bounded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.plans.ordering import add_bucket, cut_points
from textweave.plans.skew import ROWS_PER_SALT, grid_join


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ (session time zone: UTC)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(col.cast("timestamp"))


def window_join(
    left: DataFrame, right: DataFrame, before: int, after: int, right_id: str, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Pairs with right._t in [left._t - before, left._t + after] (microseconds, column ``_t`` on both sides).

    The right side sits in one bucket of width before+after, the left side in the two or three it can reach,
    so no pair appears twice. A bucket with many rows on either side, or on both, is cut into a grid of salts.
    """
    width = max(1, before + after)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    reach = F.sequence(bucket(F.col("_t") - before), bucket(F.col("_t") + after))
    lefts = left.withColumn("_lt", F.col("_t")).withColumn("_bucket", F.explode(reach))
    rights = right.withColumnRenamed("_t", "_rt").withColumn("_bucket", bucket(F.col("_rt")))
    gap = F.col("_rt") - F.col("_lt")
    return (
        grid_join(rights, lefts, ["_bucket"], [right_id], left.columns, rows_per_salt)
        .filter((gap >= -before) & (gap <= after))
        .withColumn("_gap", gap)
        .drop("_bucket", "_t", "_lt", "_rt")
    )


def nearest_times(doc_times: DataFrame, row_times: DataFrame) -> DataFrame:
    """For each distinct ``doc_times._t`` the row of ``row_times(_t, row_id)`` nearest in time.

    Returns (_t, row_id, _gap) with the absolute gap; of two equally near rows the smaller row_id wins. Both
    sides collapse to one entry per instant, the time line is cut at sketch quantiles, each piece is scanned by
    its own task, and the last/first row of every piece is carried over the pieces that follow/precede.
    """
    rows = row_times.groupBy("_t").agg(F.min("row_id").alias("row_id"))
    docs = doc_times.select("_t").distinct()
    line = (
        rows.select("_t", "row_id", F.lit(False).alias("_doc"))
        .unionByName(docs.select("_t", F.lit(None).cast("bigint").alias("row_id"), F.lit(True).alias("_doc")))
        .groupBy("_t")
        .agg(F.min("row_id").alias("row_id"), F.max("_doc").alias("_doc"))
    )
    cuts = cut_points(row_times.select("_t").unionByName(doc_times.select("_t")), "_t")
    line = add_bucket(line, "_t", cuts).withColumn(
        "_row", F.when(F.col("row_id").isNotNull(), F.struct("_t", "row_id"))
    )
    edges = line.groupBy("_b").agg(F.max("_row").alias("_last"), F.min("_row").alias("_first"))
    up = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    down = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carried = edges.select(
        "_b",
        F.last("_last", ignorenulls=True).over(up).alias("_prev_piece"),
        F.first("_first", ignorenulls=True).over(down).alias("_next_piece"),
    )
    back = Window.partitionBy("_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_b").orderBy(F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = (
        line.withColumn("_p", F.last("_row", ignorenulls=True).over(back))
        .withColumn("_n", F.last("_row", ignorenulls=True).over(ahead))
        .filter("_doc")
        .join(F.broadcast(carried), "_b")
        .withColumn("_p", F.coalesce("_p", "_prev_piece"))
        .withColumn("_n", F.coalesce("_n", "_next_piece"))
    )
    option = lambda side: F.when(
        F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}._t") - F.col("_t")).alias("gap"), F.col(f"{side}.row_id").alias("row_id"))
    )
    best = F.least(option("_p"), option("_n"))
    return near.withColumn("_best", best).filter(F.col("_best").isNotNull()).select(
        "_t", F.col("_best.row_id").alias("row_id"), F.col("_best.gap").alias("_gap")
    )
