"""Summaries, sentiment trends and topics per calendar period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.functions.metadata import sentiment_score
from textweave.functions.text import whitespace_tokens
from textweave.functions.time import period_label, period_start
from textweave.operators.filters import numeric_columns

SHORTEST_TOPIC = 4  # characters


def numeric_summary(rows: DataFrame, time_column: str = "ts", period: str = "W", columns: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, min, max and count of each numeric column per period."""
    columns = columns or [c for c in numeric_columns(rows) if c != "row_id"]
    aggregates: list[Column] = []
    for c in columns:
        aggregates += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"), F.count(c).alias(f"{c}_count"),
        ]
    dated = rows.filter(F.col(time_column).isNotNull())
    return dated.groupBy(period_start(time_column, period).alias("_start")).agg(*aggregates)


def document_counts(documents: DataFrame, period: str = "W") -> DataFrame:
    """Dated documents per period."""
    dated = documents.filter(F.col("ts").isNotNull())
    return dated.groupBy(period_start("ts", period).alias("_start")).agg(F.count(F.lit(1)).alias("document_count"))


def with_label(df: DataFrame, period: str) -> DataFrame:
    """Replace the period's first day by its label."""
    return df.select(period_label("_start", period).alias("period"), *[c for c in df.columns if c != "_start"])


def temporal_summary(
    documents: DataFrame, rows: DataFrame, time_column: str = "ts", period: str = "W", columns: list[str] | None = None
) -> DataFrame:
    """Numeric summary and document count per period, periods of either side kept."""
    numbers = numeric_summary(rows, time_column, period, columns)
    return with_label(numbers.join(document_counts(documents, period), "_start", "full_outer"), period)


def sentiment_trend(documents: DataFrame, period: str = "D", how: str = "mean", field: str = "sentiment") -> DataFrame:
    """Score of the documents' sentiment labels per period, and how many had one."""
    score = sentiment_score(F.try_element_at("metadata", F.lit(field)))
    scored = documents.filter(F.col("ts").isNotNull()).select(
        period_start("ts", period).alias("_start"), score.alias("score")
    ).filter(F.col("score").isNotNull())
    # scores take three values only, so the exact median needs three counters per period
    pick = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}.get(how, F.avg)
    trend = scored.groupBy("_start").agg(pick("score").alias("sentiment_score"), F.count(F.lit(1)).alias("document_count"))
    return with_label(trend, period)


def own_topics(text: str, stop_words: Sequence[str]) -> Column:
    """Words of a text that can be topics, repeats included."""
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    return F.filter(whitespace_tokens(text), lambda w: (F.length(w) >= SHORTEST_TOPIC) & ~F.array_contains(stop, w))


def topic_counts(documents: DataFrame, stop_words: Sequence[str], period: str = "W", topics: str | None = None) -> DataFrame:
    """Topic occurrences per period: listed topics where any document of the period has them, else its words.

    ``topics`` names an ARRAY<STRING> column; ``stop_words``, lower case, never count as topics.
    """
    listed = F.col(topics) if topics else F.lit(None).cast("array<string>")
    own = own_topics("text", stop_words)
    dated = documents.filter(F.col("ts").isNotNull()).select(
        period_start("ts", period).alias("_start"), listed.alias("listed"), "text"
    )
    count = F.count(F.lit(1)).alias("n")
    if not topics:
        return dated.select("_start", F.explode(own).alias("topic")).groupBy("_start", "topic").agg(count)
    with_list = dated.filter(F.col("listed").isNotNull()).select("_start").distinct()
    named = dated.select("_start", F.explode(F.array_compact("listed")).alias("topic")).groupBy("_start", "topic").agg(count)
    words = (
        dated.join(with_list, "_start", "left_anti")
        .select("_start", F.explode(own).alias("topic")).groupBy("_start", "topic").agg(count)
    )
    return named.unionByName(words)


def top_topics(documents: DataFrame, stop_words: Sequence[str], period: str = "W", n: int = 5, topics: str | None = None) -> DataFrame:
    """The ``n`` most frequent topics per period as ranked rows; ties by name."""
    rank = Window.partitionBy("_start").orderBy(F.col("n").desc(), "topic")
    ranked = topic_counts(documents, stop_words, period, topics).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)
    return with_label(ranked.select("_start", "rank", "topic", "n"), period)


def topic_lists(documents: DataFrame, stop_words: Sequence[str], period: str = "W", n: int = 5, topics: str | None = None) -> DataFrame:
    """The same as one list of at most ``n`` topics per period."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "topic")))
    return top_topics(documents, stop_words, period, n, topics).groupBy("period").agg(F.transform(ordered, lambda t: t["topic"]).alias("topics"))
