"""Counting concordant pairs in O(n log n) rows instead of comparing all pairs.

A point with dense x-rank r must be compared with the points of rank < r. That range splits into at most log2(n)
aligned blocks, one per set bit of r, so every point is written once per level and every comparison becomes a running
total over y inside one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.plans.ordering import cut_points, running_totals
from textweave.plans.skew import salted_join


def concordant_pairs(pairs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(groups, concordant) for ``pairs(groups, x, y, n)``, each (x, y) of a group listed once with its count.

    All groups are counted in one job; without groups the result is one row.
    """
    groups = groups or []
    distinct_x = pairs.select(*groups, "x").distinct().withColumn("one", F.lit(1))
    ranks = running_totals(distinct_x, "x", "one", groups).select(*groups, "x", F.col("before").cast("bigint").alias("r"))
    placed = salted_join(pairs, ranks, [*groups, "x"], ["y"])
    top = distinct_x.groupBy(*groups).count().agg(F.max("count").alias("m")).first()["m"] or 0
    levels = max(1, (top - 1).bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    spread = placed.select(*groups, "r", "y", F.col("n").cast("double").alias("n"), level)
    block = F.expr("shiftright(r, level)")
    is_right = F.expr("shiftright(r, level) & 1") == 1
    # a right sibling asks its left sibling block; a left sibling is what gets counted
    entries = spread.select(
        *groups,
        "level",
        F.when(is_right, block - 1).otherwise(block).alias("block"),
        "y",
        F.when(is_right, F.lit(0.0)).otherwise(F.col("n")).alias("w"),
        F.when(is_right, F.col("n")).otherwise(F.lit(0.0)).alias("asks"),
    )
    merged = entries.groupBy(*groups, "level", "block", "y").agg(F.sum("w").alias("w"), F.sum("asks").alias("asks"))
    cuts = cut_points(pairs, "y")
    totals = running_totals(merged, "y", "w", [*groups, "level", "block"], cuts)
    concordant = F.coalesce(F.sum(F.col("asks") * F.col("before")), F.lit(0.0)).alias("concordant")
    return totals.groupBy(*groups).agg(concordant) if groups else totals.agg(concordant)
