"""Descriptive statistics, profiles, correlations, distributions, classification scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.operators.filters import numeric_columns
from textweave.plans.concordance import concordant_pairs
from textweave.plans.lineage import cut_lineage
from textweave.plans.ordering import average_ranks, running_totals, summaries
from textweave.plans.skew import salted_join


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(column, value) with one record per cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns]))
    return df.select(cells.alias("cell")).select("cell.column", "cell.value")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max, one record per numeric column."""
    cells = _long(df, list(columns or numeric_columns(df)), "double").filter(F.col("value").isNotNull())
    basic = [
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ]
    told = summaries(cells, "value", [0.25, 0.5, 0.75], ["column"], basic)
    quartiles = [F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))]
    return told.select("column", "count", "mean", "std", "min", *quartiles, "max")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column, counted by value first so that no task holds a value set."""
    cells = _long(df, list(columns or df.columns), "string").filter(F.col("value").isNotNull()).distinct()
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, most: int = 10) -> DataFrame:
    """How often each value occurs, for the columns with at most ``most`` distinct values."""
    cells = _long(df, list(columns or df.columns), "string").filter(F.col("value").isNotNull())
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counted.groupBy("column").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= most).select("column")
    return counted.join(few, "column", "left_semi")


def metadata_profile(df: DataFrame, prefix: str = "metadata_") -> DataFrame:
    """Non-null, null and distinct counts of the metadata columns."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    cells = _long(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    null = F.col("value").isNull()
    return cells.groupBy("column").agg(
        F.sum(F.when(~null, F.col("n")).otherwise(0)).alias("n_present"),
        F.sum(F.when(null, F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(~null, 1).otherwise(0)).alias("n_distinct"),
    )


# -- correlation ---------------------------------------------------------------------------------------------------


def _pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _counted_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, x, y, n): the records that both columns of a pair have, equal ones counted together; one scan for all pairs."""
    d = lambda c: F.col(c).cast("double")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), d(a).alias("x"), d(b).alias("y")) for i, (a, b) in enumerate(pairs)]))
    kept = df.select(cells.alias("c")).select("c.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return cut_lineage(kept.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")))


def _named(found: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlations by pair number with the names of the pair's columns; a pair without records has none."""
    names = found.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, variable_1 string, variable_2 string")
    return names.join(found, "pair", "left").select("variable_1", "variable_2", "correlation")


def _rank_level(total: str) -> Column:
    """Total times the mean rank squared; a double, as the cube of some two million records is beyond a bigint."""
    t = F.col(total).cast("double")
    return t * (t + 1) * (t + 1) / 4


def _spearman_by_pair(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson on average ranks among the records that both columns of a pair have, all pairs in one job."""
    counted = _counted_pairs(df, pairs)
    ranked = counted
    for c in ("x", "y"):
        values = counted.groupBy("pair", c).agg(F.sum("n").alias("_m"))
        rank = (F.col("before") + (F.col("_m") + 1) / 2).alias(f"r_{c}")
        ranked = salted_join(ranked, running_totals(values, c, "_m", ["pair"]).select("pair", c, rank), ["pair", c], ["x", "y"], counted=counted)
    n, x, y = F.col("n"), F.col("r_x"), F.col("r_y")
    sums = ranked.groupBy("pair").agg(F.sum("n").alias("t"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    level = _rank_level("t")
    scale = F.nullif(F.sqrt((F.col("xx") - level) * (F.col("yy") - level)), F.lit(0.0))
    return _named(sums.select("pair", ((F.col("xy") - level) / scale).alias("correlation")), pairs)


def _spearman_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson on average ranks for columns without gaps: each column is ranked once, equal records count once."""
    keys = [f"x{i}" for i in range(len(columns))]
    base = cut_lineage(
        df.select(*[F.col(c).cast("double").alias(k) for c, k in zip(columns, keys)]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    )
    counted = base
    for k in keys:
        values = base.groupBy(k).agg(F.sum("n").alias("_m"))
        rank = (F.col("before") + (F.col("_m") + 1) / 2).alias(f"r_{k}")
        ranks = running_totals(values, k, "_m").select(k, rank)
        counted = salted_join(counted, ranks, [k], keys, counted=base)
    n, pairs = F.col("n"), list(combinations(range(len(columns)), 2))
    r = lambda i: F.col(f"r_x{i}")
    sums = [F.sum(n * r(i) * r(j)).alias(f"s{i}_{j}") for i, j in [*pairs, *((i, i) for i in range(len(columns)))]]
    wide = counted.agg(F.sum("n").alias("total"), *sums)
    level = _rank_level("total")
    spread = lambda i, j: F.col(f"s{i}_{j}") - level
    cells = [
        F.struct(
            F.lit(columns[i]).alias("variable_1"), F.lit(columns[j]).alias("variable_2"),
            (spread(i, j) / F.nullif(F.sqrt(spread(i, i) * spread(j, j)), F.lit(0.0))).alias("correlation"),
        )
        for i, j in pairs
    ]
    return wide.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def _spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with gaps are ranked per pair, on the records both columns have; the others once for all pairs."""
    missing = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    gaps = df.agg(*[F.count_if(missing(c)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    full = [c for i, c in enumerate(columns) if gaps[f"g{i}"] == 0]
    parts = [_spearman_complete(df, full)] if len(full) > 1 else []
    if with_gaps := [(a, b) for a, b in combinations(columns, 2) if a not in full or b not in full]:
        parts.append(_spearman_by_pair(df, with_gaps))
    return reduce(lambda p, q: p.unionByName(q), parts)


def _kendall(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """tau-b from tie counts and the number of concordant pairs, all pairs of columns in one job."""
    counted = _counted_pairs(df, pairs)
    d = lambda c: F.col(c).cast("double")
    ties = lambda t, c: t.groupBy("pair").agg(F.sum(d("n") * (d("n") - 1) / 2).alias(c))
    marginal = lambda c: counted.groupBy("pair", c).agg(F.sum("n").alias("n"))
    parts = counted.groupBy("pair").agg(F.sum(d("n")).alias("_total"))
    for part in (ties(counted, "both"), ties(marginal("x"), "tx"), ties(marginal("y"), "ty"), concordant_pairs(counted, ["pair"])):
        parts = parts.join(part, "pair")
    all_pairs = F.col("_total") * (F.col("_total") - 1) / 2
    discordant = all_pairs - F.col("tx") - F.col("ty") + F.col("both") - F.col("concordant")
    scale = F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty")))
    return _named(parts.select("pair", ((F.col("concordant") - discordant) / F.nullif(scale, F.lit(0.0))).alias("correlation")), pairs)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Upper triangle of the correlation matrix: (variable_1, variable_2, correlation)."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    if method == "pearson":
        return _pearson(df, pairs)
    if method == "spearman":
        return _spearman(df, columns)
    if method != "kendall":
        raise ValueError(f"unknown method {method!r}")
    return _kendall(df, pairs)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """The full matrix in long form, diagonal 1."""
    columns = list(columns or numeric_columns(df))
    upper = correlation_pairs(df, columns, method)
    cells = F.explode(
        F.array(
            F.struct(F.col("variable_1").alias("a"), F.col("variable_2").alias("b")),
            F.struct(F.col("variable_2").alias("a"), F.col("variable_1").alias("b")),
        )
    )
    both = upper.select(cells.alias("e"), "correlation").select(
        F.col("e.a").alias("variable_1"), F.col("e.b").alias("variable_2"), "correlation"
    )
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("variable_1")
    diagonal = df.sparkSession.range(1).select(names).select(
        "variable_1", F.col("variable_1").alias("variable_2"), F.lit(1.0).alias("correlation")
    )
    return both.unionByName(diagonal)


def significant_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.5, method: str = "pearson"
) -> DataFrame:
    """Pairs with |r| of at least ``threshold``, strongest first."""
    strong = correlation_pairs(df, columns, method).filter(F.abs("correlation") >= threshold)
    return strong.orderBy(F.abs("correlation").desc(), "variable_1", "variable_2")


def rank_table(df: DataFrame, column: str) -> DataFrame:
    """Average rank of every distinct value."""
    return average_ranks(df.filter(F.col(column).isNotNull()), column)


# -- lengths -------------------------------------------------------------------------------------------------------


def _lengths(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return documents.filter(F.col(text).isNotNull()).select(*keys, F.length(text).cast("double").alias("len"))


def length_statistics(documents: DataFrame, text: str = "text", group: str | None = None) -> DataFrame:
    """Mean, median, population deviation, 1 % and 99 % quantiles of text length, overall or per group."""
    keys = [group] if group else []
    basic = [F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), F.stddev_pop("len").alias("std")]
    told = summaries(_lengths(documents, text, keys), "len", [0.01, 0.5, 0.99], keys, basic)
    quantiles = [F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("p01", "median", "p99"))]
    return told.select(*keys, "n", "mean", "std", *quantiles)


def length_histogram(documents: DataFrame, bins: int = 100, text: str = "text", group: str | None = None) -> DataFrame:
    """Documents per equal-width length bin (bin, n); empty bins are left out.

    Without a group the range is one record and goes to every task, so lengths are binned where they are read.
    """
    keys = [group] if group else ["_whole"]
    lengths = _lengths(documents, text, [group] if group else [])
    lengths = lengths if group else lengths.withColumn("_whole", F.lit(1))
    span = lengths.groupBy(*keys).agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    joined = lengths.join(span if group else F.broadcast(span), keys)
    # a single length sits in the middle of a range of width one
    lo = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    number = F.least(F.floor((F.col("len") - lo) / width), F.lit(bins - 1)).cast("int")
    return joined.groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).drop("_whole")


# -- groups and classification -------------------------------------------------------------------------------------


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_members(df: DataFrame, cluster: str, row_id: str = "row_id") -> DataFrame:
    """Members as (cluster, row_id) records; a list per cluster would put a whole cluster into one task."""
    return df.select(cluster, row_id)


def cluster_profile(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Size and column means of every cluster."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def array_profile(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Size and mean of every vector coordinate per cluster, long: (cluster, dim, mean, n)."""
    cells = df.select(cluster, F.posexplode(vector).alias("dim", "value"))
    return cells.groupBy(cluster, "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """True/false positive/negative counts of 0/1 columns and accuracy, precision, recall, F1 (0 when undefined)."""
    a, p = F.col(actual).cast("int"), F.col(predicted).cast("int")
    hits = lambda x, y: F.count_if((a == x) & (p == y))
    c = df.agg(hits(1, 1).alias("tp"), hits(0, 1).alias("fp"), hits(0, 0).alias("tn"), hits(1, 0).alias("fn"))
    return with_scores(c)


def with_scores(counts: DataFrame) -> DataFrame:
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows by actual class, one column per predicted class 0 and 1."""
    return df.groupBy(F.col(actual).alias("actual")).pivot(predicted, [0, 1]).count().select(
        "actual", F.coalesce("0", F.lit(0)).alias("predicted_0"), F.coalesce("1", F.lit(0)).alias("predicted_1")
    )
