"""Preparing the numeric frame: binning, encoding, scaling, balancing, sequences, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.functions.text import whitespace_tokens
from textweave.operators.filters import drop_missing, split_xy
from textweave.operators.linkage import HubLinks, rows_with_outcome, text_outcome
from textweave.plans.lineage import cut_lineage
from textweave.plans.lookup import with_lookup
from textweave.plans.ordering import values_at_ranks, with_dense_index
from textweave.plans.skew import salted_join

COLUMNS = 1000  # levels of a column that can become columns; more become one sparse column
COPIES = 10_000  # copies of a record that one row gives
VOCABULARY = 10_000  # fixed value: words of a sequence vocabulary
SEQUENCE_LENGTH = 100  # fixed value: tokens of a sequence


def _fit(df: DataFrame, aggregates: list[Column]) -> dict:
    """Column statistics as plain numbers: one record, whatever the size of the data."""
    return df.agg(*aggregates).first().asDict()


def bin_column(df: DataFrame, column: str, bins: int = 2) -> DataFrame:
    """Equal-width codes 0..bins-1, intervals closed on the right, the smallest value in bin 0."""
    s = _fit(df, [F.min(column).alias("lo"), F.max(column).alias("hi")])
    if s["lo"] is None:
        return df
    x = F.col(column).cast("double")
    lo, hi = float(s["lo"]), float(s["hi"])
    if lo == hi:
        code = F.when(x.isNotNull(), F.lit((bins + 1) // 2 - 1))
    else:
        code = F.greatest(F.ceil((x - lo) / ((hi - lo) / bins)) - 1, F.lit(0))
        code = F.least(code, F.lit(bins - 1))
    return df.withColumn(column, F.when(x.isNotNull(), code.cast("int")))


def level_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, number): the levels of each column numbered from 0 in sort order, as a written table of any length."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns]))
    distinct = df.select(cells.alias("e")).select("e.column", "e.level").filter(F.col("level").isNotNull()).distinct()
    placed = cut_lineage(with_dense_index(distinct, ["column", "level"], "_at"))
    first = placed.groupBy("column").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "column").select("column", "level", (F.col("_at") - F.col("_first")).alias("number"))


def _widths(numbers: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    found = {r["column"]: r["n"] for r in numbers.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in columns}


def one_hot_sparse(df: DataFrame, columns: Sequence[str], name: str = "features", numbers: DataFrame | None = None) -> DataFrame:
    """``columns`` replaced by one sparse vector ``name(size, indices, values)``: a place for each level but a column's first.

    Levels are numbered by a table and joined, so neither their number nor a level that fills the column matters. Missing
    cells and first levels have no entry. ``ml.assemble`` takes such columns as features.
    """
    numbers = level_numbers(df, columns) if numbers is None else numbers
    widths = _widths(numbers, columns)
    spread = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out, places, offset = df, [], 0
    for i, c in enumerate(columns):
        own = numbers.filter(F.col("column") == c).select(F.col("level").cast(df.schema[c].dataType).alias(c), F.col("number").alias(f"_number{i}"))
        out = salted_join(out, own, [c], spread, "left")
        places.append(F.when(F.col(f"_number{i}") > 0, F.col(f"_number{i}") + (offset - 1)))
        offset += max(0, widths[c] - 1)
    indices = F.array_compact(F.array(*places)).cast("array<int>")
    vector = F.struct(F.lit(offset).alias("size"), indices.alias("indices"), F.transform(indices, lambda i: F.lit(1.0)).alias("values"))
    return out.withColumn(name, vector).select(*[c for c in df.columns if c not in columns], name)


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column replaced by ``column_level`` 0/1 columns, the first level in sort order left out.

    A column with more levels than a table can have columns becomes one sparse vector ``column_levels`` with the same
    entries (see ``one_hot_sparse``).
    """
    if not columns:
        return df
    numbers = level_numbers(df, columns)
    widths = _widths(numbers, columns)
    wide = [c for c in columns if widths[c] > COLUMNS]
    few = numbers.filter(F.col("column").isin([c for c in columns if c not in wide])).orderBy("column", "number").collect()  # at most COLUMNS a column
    for c in wide:
        df = one_hot_sparse(df, [c], f"{c}_levels", numbers.filter(F.col("column") == c))
    kept = [F.col(c) for c in df.columns if c not in columns]
    made = [
        F.coalesce((F.col(r["column"]) == r["level"]).cast("int"), F.lit(0)).alias(f"{r['column']}_{r['level']}")
        for c in columns for r in few if r["column"] == c and r["number"] > 0
    ]
    return df.select(*kept, *made)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def one_hot_strings(df: DataFrame, most: int = 10, skip_wide: bool = False) -> DataFrame:
    """One-hot of every string column; columns with more than ``most`` levels stay as they are if asked."""
    columns = string_columns(df)
    if skip_wide and columns:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))
        distinct = df.select(cells.alias("e")).select("e.c", "e.v").filter(F.col("v").isNotNull()).distinct()
        wide = {r["c"] for r in distinct.groupBy("c").count().filter(F.col("count") > most).collect()}
        columns = [c for c in columns if c not in wide]
    return one_hot(df, columns)


def encode_booleans(df: DataFrame) -> DataFrame:
    """Every cell to a boolean: 0 and false are false, everything else (missing too) is true."""

    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StructType):  # a sparse vector is 0/1 already
            return F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return F.coalesce(F.col(f.name), F.lit(True))
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(F.col(f.name) != 0, F.lit(True))
        return F.lit(True)

    return df.select(*[cell(f).alias(f.name) for f in df.schema])


def oversample(df: DataFrame, label: str, row_id: str = "row_id") -> DataFrame:
    """Repeat records of the smaller classes until every class is as large as the largest.

    Every record of a class is repeated equally often; the remainder goes to the records that come first by hash.
    That cut is found by counting, so a class is never gathered.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n").alias("m")).first()["m"] or 0
    plan = sizes.withColumn("_copies", F.floor(F.lit(most) / F.col("_n")).cast("int")).withColumn(
        "_rest", (F.lit(most) - F.col("_copies") * F.col("_n")).cast("bigint")
    )
    hashed = df.withColumn("_h", F.xxhash64(row_id))
    ranks = plan.filter(F.col("_rest") > 0).select(label, (F.col("_rest") - 1).alias("_rank"))
    weights = hashed.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("_w"))
    last = values_at_ranks(weights, ranks, "_h", "_w", [label], "_rank").select(label, F.col("_h").alias("_last"))
    small = plan.join(last, label, "left").select(label, "_copies", "_last")
    extra = F.when(F.col("_h") <= F.col("_last"), 1).otherwise(0)
    sized = hashed.join(small, label).withColumn("_all", F.col("_copies") + extra)
    many = plan.agg(F.max("_copies").alias("c")).first()["c"] or 0
    parts = F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / COPIES).cast("int"))
    spread = sized.withColumn("_part", F.explode(parts))
    if many > COPIES:  # the copies of a record are made by several tasks; a given number is not merged again
        spread = spread.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h", "_part")
    low = F.col("_part") * COPIES
    copies = F.sequence(low + 1, F.least(low + COPIES, F.col("_all")))
    return spread.withColumn("copy", F.explode(copies)).select(*df.columns, "copy")


def prepare(
    df: DataFrame, outcome: str, balance: bool = False, booleans: bool = False, row_id: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Drop records with missing cells, balance classes, one-hot the strings, encode booleans; then X and y.

    X and y each keep ``row_id`` when it is given.
    """
    clean = drop_missing(df)
    if balance:
        clean = oversample(clean, outcome, row_id or "row_id").drop("copy")
    label_is_text = outcome in string_columns(clean)
    text = [c for c in string_columns(clean) if not (label_is_text and c == outcome)]
    encoded = one_hot(clean, text)
    if booleans:
        encoded = encode_booleans(encoded)
    return split_xy(encoded, outcome)


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0.5."""
    s = _fit(df, [f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = s[f"lo_{c}"], s[f"hi_{c}"]
        if lo is None or hi == lo:
            return F.lit(0.5)
        return (F.col(c).cast("double") - lo) / (hi - lo)

    return df.withColumns({c: scaled(c) for c in columns})


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the mean, then z-scores with the population deviation; an all-missing column becomes 0."""
    x = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    s = _fit(df, [e for c in columns for e in (
        F.avg(x(c)).alias(f"m_{c}"), F.sum(x(c)).alias(f"s_{c}"), F.stddev_pop(x(c)).alias(f"d_{c}"),
        F.count(x(c)).alias(f"k_{c}"), F.count(F.lit(1)).alias(f"n_{c}"))])

    def z(c: str) -> Column:
        mean, deviation = s[f"m_{c}"], s[f"d_{c}"]
        if mean is None:
            return F.lit(0.0)
        # filled cells sit on the mean: they add to the count, not to the squares
        deviation = deviation * (s[f"k_{c}"] / s[f"n_{c}"]) ** 0.5
        return (F.coalesce(x(c), F.lit(mean)) - mean) / (deviation or 1.0)

    return df.withColumns({c: z(c) for c in columns})


def binary_target(df: DataFrame, column: str, name: str = "target") -> DataFrame:
    """0 for the smallest value, 1 for every other."""
    least = _fit(df, [F.min(column).alias("v")])["v"]
    return df.withColumn(name, F.when(F.col(column).isNotNull(), (F.col(column) != F.lit(least)).cast("int")))


def with_linked_outcome(documents: DataFrame, rows: DataFrame, links: DataFrame | HubLinks, field: str, how: str = "majority", name: str = "outcome") -> DataFrame:
    """The linked rows with a metadata field of their documents as ``name``, a number.

    An outcome with any value that is no number is a class: its values are numbered from 0 in alphabetical order. Links
    through a hub (period, keyword) are not listed pair by pair: a hub's values are counted once for all its rows.
    """
    joined = rows_with_outcome(rows, text_outcome(documents, links, field, how), name)
    number = F.col(name).try_cast("double")
    if not _fit(joined, [F.coalesce(F.bool_or(F.col(name).isNotNull() & number.isNull()), F.lit(False)).alias("v")])["v"]:
        return joined.withColumn(name, number)
    labels = joined.filter(F.col(name).isNotNull()).select(name).distinct()
    numbered = with_dense_index(labels, [name], "_class").select(F.col(name).alias("_label"), F.col("_class").cast("double"))
    return joined.join(numbered, F.col(name) == F.col("_label"), "left").drop(name, "_label").withColumnRenamed("_class", name)


def linked_xy(
    documents: DataFrame, rows: DataFrame, links: DataFrame | HubLinks, field: str, how: str = "majority",
    balance: bool = False, booleans: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Features and a text outcome: linked rows only, prepared like any other frame."""
    return prepare(with_linked_outcome(documents, rows, links, field, how), "outcome", balance, booleans, "row_id")


def linked_frame(
    documents: DataFrame, rows: DataFrame, links: DataFrame | HubLinks, field: str, columns: Sequence[str], how: str = "majority",
    balance: bool = False, row_id: str = "row_id",
) -> tuple[DataFrame, list[str]]:
    """(frame, features): linked rows without gaps as (row_id, features..., ``field``), strings one-hot, classes balanced if asked.

    A copied row of a balanced frame gets an id of its own.
    """
    frame = drop_missing(with_linked_outcome(documents, rows.select(row_id, *columns), links, field, how, field))
    if balance:
        frame = oversample(frame, field, row_id)
        frame = frame.withColumn(row_id, F.concat_ws("#", F.col(row_id).cast("string"), F.col("copy").cast("string"))).drop("copy")
    text = [c for c in string_columns(frame) if c in columns]
    encoded = one_hot(frame, text)
    features = [c for c in encoded.columns if c not in (row_id, field)]
    return encoded.select(row_id, *features, field), features


def vocabulary(documents: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(token, index): the most frequent tokens, numbered from 1; at most ``size`` records."""
    counted = documents.select(F.explode(whitespace_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.col("n").desc(), "token").limit(size)
    return top.select("token", F.row_number().over(Window.orderBy(F.col("n").desc(), "token")).alias("index"))


def token_sequences(documents: DataFrame, size: int = VOCABULARY, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """(doc_id, sequence): the first ``length`` tokens as vocabulary numbers, 0 for unknown words and padding."""
    words = F.slice(whitespace_tokens("text"), 1, length)
    texts = documents.select(F.col("id").alias("doc_id"), F.coalesce(words, F.array().cast("array<string>")).alias("tokens"))
    coded = with_lookup(texts, "tokens", vocabulary(documents, size), "token", ["index"])
    numbers = F.transform("index", lambda i: F.coalesce(i, F.lit(0)))
    return coded.select("doc_id", F.concat(numbers, F.array_repeat(F.lit(0), length - F.size("tokens"))).alias("sequence"))


def train_test_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same record always falls on the same side."""
    in_test = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(10_000)) < int(round(test_share * 10_000))
    return df.filter(~in_test), df.filter(in_test)


def scaler_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, std_pop): what the scalers use, from one pass."""
    wide = df.agg(
        *[e for c in columns for e in (
            F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"),
            F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"d_{c}"))]
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
                 F.col(f"m_{c}").alias("mean"), F.col(f"d_{c}").alias("std_pop"))
        for c in columns
    ]
    return wide.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
