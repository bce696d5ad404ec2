"""Global order without a global task: cut points, running totals, exact quantiles, dense indexes."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.plans.lineage import cut_lineage

BUCKETS = 64  # between the cut points of a group
GROUPS_HELD = 10_000  # groups whose cut points are broadcast
INDEX_BITS = 33  # monotonically_increasing_id keeps the position inside a partition in its low 33 bits


def bucket_count(df: DataFrame) -> int:
    """How many ordered buckets to cut a column into: a few per shuffle partition, bounded."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(4096, 2 * partitions))


def cut_points(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Increasing values that split ``column`` into buckets of similar size (a sketch, bounded in size).

    Only the balance of later tasks depends on these values, never a result.
    """
    n = buckets or bucket_count(df)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, F.lit(max(1000, 8 * n))).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def add_bucket(df: DataFrame, column: str, cuts: list[float], name: str = "_b") -> DataFrame:
    """Bucket number of ``column`` by a binary search over ``cuts`` inside the JVM."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    numeric = f"{name}_value"
    return (
        Bucketizer(splits=splits, inputCol=numeric, outputCol=name)
        .transform(df.withColumn(numeric, F.col(column).cast("double")))
        .withColumn(name, F.col(name).cast("int"))
        .drop(numeric)
    )


def running_totals(
    weighted: DataFrame, value: str, weight: str, groups: list[str] | None = None, cuts: list[float] | None = None
) -> DataFrame:
    """Add ``before`` = sum of ``weight`` over smaller ``value``s of the same group.

    ``weighted`` holds each (groups, value) once. Totals per bucket are summed first, so a window only ever
    sees one bucket, or one total per bucket.
    """
    groups = groups or []
    cuts = cut_points(weighted, value) if cuts is None else cuts
    cut = add_bucket(weighted, value, cuts)
    inside = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*groups, "_b")
        .agg(F.sum(weight).alias("_t"))
        .withColumn("_offset", F.coalesce(F.sum("_t").over(across), F.lit(0)))
        .drop("_t")
    )
    if not groups:
        offsets = F.broadcast(offsets)  # one row per bucket
    return (
        cut.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [*groups, "_b"])
        .withColumn("before", F.col("_in") + F.col("_offset"))
        .drop("_in", "_offset", "_b")
    )


def values_at_ranks(
    counts: DataFrame, ranks: DataFrame, value: str, weight: str, groups: list[str], rank: str
) -> DataFrame:
    """The value at each 0-based ``rank``: ``counts(groups, value, weight)`` against ``ranks(groups, rank)``.

    Only buckets that hold a wanted rank are ordered row by row.
    """
    cut = add_bucket(counts, value, cut_points(counts, value))
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        cut.groupBy(*groups, "_b")
        .agg(F.sum(weight).alias("_t"))
        .withColumn("_lo", F.coalesce(F.sum("_t").over(across), F.lit(0)))
    )
    in_bucket = (F.col(rank) >= F.col("_lo")) & (F.col(rank) < F.col("_lo") + F.col("_t"))
    if groups:
        wanted = ranks.join(buckets, groups).filter(in_bucket)
    else:
        one = F.lit(0)  # a handful of ranks against one row per bucket
        wanted = buckets.withColumn("_k", one).join(F.broadcast(ranks.withColumn("_k", one)), "_k").filter(in_bucket)
    wanted = wanted.select(*groups, "_b", "_lo", rank)
    inside = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    needed = wanted.select(*groups, "_b").distinct()
    ordered = (
        cut.join(needed, [*groups, "_b"], "left_semi")
        .withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    )
    start = F.col("_lo") + F.col("_in")
    return (
        ordered.join(wanted, [*groups, "_b"])
        .filter((F.col(rank) >= start) & (F.col(rank) < start + F.col(weight)))
        .select(*groups, rank, value)
    )


def summaries(df: DataFrame, column: str, probabilities: list[float], groups: list[str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    """(groups, extra aggregates, q): exact linear-interpolated quantiles of ``column`` per group, as an array in the order asked.

    One pass sketches cut points of every group, next to the ``extra`` aggregates. A second one counts the values between
    cut points where they are read. Only values of the few buckets that hold a wanted rank are then shuffled, equal ones
    as one record. Cut points decide how much that is, never a result. Missing values and NaN do not count; a group without
    any other value has no quantiles.
    """
    groups = groups or []
    keys = groups or ["_whole"]
    source = df if groups else df.withColumn("_whole", F.lit(1))
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    marks = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    sketch = F.percentile_approx(value, marks, F.lit(20 * BUCKETS)).alias("_cuts")
    told = cut_lineage(source.groupBy(*keys).agg(*(extra or []), F.count(value).alias("_n"), sketch))
    cells = source.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull())
    ends = told.select(*keys, F.array_distinct("_cuts").alias("_cuts"))
    ends = ends if ends.limit(GROUPS_HELD + 1).count() > GROUPS_HELD else F.broadcast(ends)
    # how many cut points lie below the value, by halving: a place beyond the last one is null and not below
    halves = F.array(*[F.lit(BUCKETS >> i) for i in range(1, BUCKETS.bit_length())])
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col("_v"), at + step).otherwise(at))
    bucketed = cells.join(ends, keys).withColumn("_b", below).drop("_cuts")
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_t")).withColumn("_low", F.coalesce(F.sum("_t").over(across), F.lit(0)))
    counts = cut_lineage(counts)  # at most BUCKETS rows a group
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)]))
    place = (F.col("_n") - 1) * F.col("_a.p")
    ranks = told.filter(F.col("_n") > 0).withColumn("_a", asked).select(*keys, F.col("_a.i").alias("_i"), place.alias("_h"))
    ranks = ranks.select(*keys, "_i", "_h", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_rank"))
    inside = (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_low") + F.col("_t"))
    wanted = cut_lineage(ranks.join(counts, keys).filter(inside).select(*keys, "_b", "_low", "_i", "_h", "_rank"))
    needed = wanted.select(*keys, "_b").distinct()
    needed = needed if needed.limit(GROUPS_HELD + 1).count() > GROUPS_HELD else F.broadcast(needed)
    kept = bucketed.join(needed, [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_w"))
    before = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ordered = kept.withColumn("_in", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    start = F.col("_low") + F.col("_in")
    found = ordered.join(wanted, [*keys, "_b"]).filter((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_w")))
    low = F.max(F.when(F.col("_rank") == F.floor("_h"), F.col("_v")))
    high = F.max(F.when(F.col("_rank") == F.ceil("_h"), F.col("_v")))
    each = found.groupBy(*keys, "_i", "_h").agg((low + (high - low) * (F.col("_h") - F.floor("_h"))).alias("q"))
    lists = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "q"))), lambda x: x["q"]).alias("q"))
    return told.drop("_cuts", "_n").join(lists, keys, "left").drop("_whole")


def exact_quantiles(
    df: DataFrame, column: str, probabilities: list[float], groups: list[str] | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per group as rows (groups, p, q); see ``summaries``."""
    listed = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), F.col("q"))
    rows = summaries(df, column, probabilities, groups).filter(F.col("q").isNotNull())
    return rows.select(*(groups or []), F.explode(listed).alias("_e")).select(*(groups or []), F.col("_e.p").alias("p"), F.col("_e.q").alias("q"))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` with count and average rank: (value, n, avg_rank)."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counts, "value", "n")
    return totals.select("value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def with_dense_index(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """Number rows start, start+1, ... in ``order`` (a total order) with no single-task window.

    Rows are range-partitioned and sorted, then written once so that both later reads see the same split;
    partition offsets come from one count per partition.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed).withColumns(
        {
            "_part": F.shiftright("_id", INDEX_BITS),
            "_pos": F.col("_id").bitwiseAND(F.lit((1 << INDEX_BITS) - 1)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_pos") + F.col("_offset") + F.lit(start))
        .drop("_id", "_part", "_pos", "_offset")
    )
