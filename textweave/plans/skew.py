"""Joins whose hot keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key outside the HOT_KEYS most frequent ones holds less than 1/HOT_KEYS of all rows, so salting only those
# bounds every task; it also bounds the broadcast side to HOT_KEYS rows.
HOT_KEYS = 1000
ROWS_PER_SALT = 500_000
MAX_SALTS = 4096


def hot_keys(df: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """At most HOT_KEYS keys that need more than one task, with the number of salts for each."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_salt)
        .orderBy(F.col("_n").desc(), *keys)
        .limit(HOT_KEYS)
        .select(
            *keys,
            F.least(F.lit(MAX_SALTS), F.ceil(F.col("_n") / rows_per_salt)).cast("int").alias("_salts"),
        )
    )


def salted_join(
    big: DataFrame,
    other: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which a hot key of ``big`` is cut into salts and ``other`` is repeated per salt.

    ``spread_by`` names columns of ``big`` whose hash picks the salt. ``how`` is inner or left. ``counted`` is a
    cheaper frame with the same keys, equally often, to count them in.
    """
    hot = F.broadcast(hot_keys(big if counted is None else counted, keys, rows_per_salt))
    left = big.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
        ),
    )
    right = other.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def grid_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_by: list[str], right_by: list[str], rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Inner equi-join in which keys that are hot on either side, or on both, are cut into a grid of salts.

    A key with n rows on the left and m on the right becomes ceil(n / rows_per_salt) x ceil(m / rows_per_salt) cells: a
    left row goes to the cells of its line, a right row to those of its column, so every pair meets once and no cell has
    more than about ``rows_per_salt`` rows of a side. ``left_by`` and ``right_by`` name columns whose hash picks the line
    and the column.
    """
    lines = hot_keys(left, keys, rows_per_salt).withColumnRenamed("_salts", "_lines")
    columns = hot_keys(right, keys, rows_per_salt).withColumnRenamed("_salts", "_columns")
    hot = F.broadcast(lines.join(columns, keys, "full"))  # at most 2 * HOT_KEYS rows
    many = lambda c: F.coalesce(F.col(c), F.lit(1))
    own = lambda by, c: F.pmod(F.xxhash64(*by), many(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), many(c) - 1))
    a = left.join(hot, keys, "left").withColumns({"_line": own(left_by, "_lines")}).withColumn("_column", every("_columns"))
    b = right.join(hot, keys, "left").withColumns({"_column": own(right_by, "_columns")}).withColumn("_line", every("_lines"))
    counts = ["_lines", "_columns"]
    return a.drop(*counts).join(b.drop(*counts), [*keys, "_line", "_column"]).drop("_line", "_column")
