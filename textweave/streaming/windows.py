"""The event-time operators on streams: the same numbers as the batch operators once the watermark has passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textweave.functions.metadata import sentiment_score
from textweave.operators.temporal import own_topics

# Window length and offset; the epoch is a Thursday, weeks start on Monday.
WINDOWS = {"D": ("1 day", "0 days"), "W": ("7 days", "4 days")}
TOP_TOPICS = "period_start date, rank int, topic string, n bigint"


def _timed(stream: DataFrame, time_column: str, delay: str) -> DataFrame:
    timed = stream.filter(F.col(time_column).isNotNull()).withColumn("_time", F.col(time_column).cast("timestamp"))
    return timed.withWatermark("_time", delay)


def _window(period: str) -> Column:
    if period not in WINDOWS:
        raise ValueError(f"period must be one of {sorted(WINDOWS)} on a stream")
    length, offset = WINDOWS[period]
    return F.window("_time", length, startTime=offset)


def _windowed(stream: DataFrame, time_column: str, period: str, delay: str):
    return _timed(stream, time_column, delay).groupBy(_window(period))


def _starts(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("date").alias("period_start"), *[c for c in df.columns if c != "window"])


def summary_stream(rows: DataFrame, columns: list[str], time_column: str = "ts", period: str = "W", delay: str = "1 day") -> DataFrame:
    """Mean, sample deviation, min, max and count of each column per period."""
    aggregates: list[Column] = []
    for c in columns:
        aggregates += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"), F.count(c).alias(f"{c}_count"),
        ]
    return _starts(_windowed(rows, time_column, period, delay).agg(*aggregates))


def document_count_stream(documents: DataFrame, period: str = "W", delay: str = "1 day") -> DataFrame:
    return _starts(_windowed(documents, "ts", period, delay).agg(F.count(F.lit(1)).alias("document_count")))


def sentiment_stream(documents: DataFrame, period: str = "D", delay: str = "1 day", field: str = "sentiment") -> DataFrame:
    """Mean, median, least and greatest sentiment score per period.

    Scores take three values, so the state of the exact median is three counters per open period.
    """
    scored = documents.withColumn("_s", sentiment_score(F.try_element_at("metadata", F.lit(field)))).filter(F.col("_s").isNotNull())
    return _starts(
        _windowed(scored, "ts", period, delay).agg(
            F.avg("_s").alias("mean"), F.median("_s").alias("median"), F.min("_s").alias("min"), F.max("_s").alias("max"),
            F.count(F.lit(1)).alias("document_count"),
        )
    )


def topic_count_stream(
    documents: DataFrame, stop_words: Sequence[str], period: str = "W", delay: str = "1 day", topics: str | None = None
) -> DataFrame:
    """(period_start, listed, topic, n) of every period that the watermark has passed; the state is one counter per topic.

    ``topics`` names an ARRAY<STRING> column of listed topics. ``listed`` tells those from a text's own words; a null topic
    counts the lists, so that an empty one is known too. Documents later than the watermark are left out.
    """
    own = F.transform(own_topics("text", stop_words), lambda w: F.struct(F.lit(False).alias("listed"), w.alias("topic")))
    if topics:
        marker = F.array(F.struct(F.lit(True).alias("listed"), F.lit(None).cast("string").alias("topic")))
        named = F.transform(topics, lambda t: F.struct(F.lit(True).alias("listed"), t.alias("topic")))
        own = F.when(F.col(topics).isNotNull(), F.concat(marker, F.filter(named, lambda e: e["topic"].isNotNull()))).otherwise(own)
    found = _timed(documents, "ts", delay).select("_time", F.explode(own).alias("e"))
    counted = found.groupBy(_window(period), F.col("e.listed").alias("listed"), F.col("e.topic").alias("topic"))
    return _starts(counted.agg(F.count(F.lit(1)).alias("n")))


def rank_closed(counts: DataFrame, n: int = 5) -> DataFrame:
    """(period_start, rank, topic, n) from a batch of closed periods: listed topics where a period has any, else words.

    One shuffle by period of at most n + 1 rows per period and task: lists come first, and words go only where none came.
    """
    by_period = Window.partitionBy("period_start")
    order = [F.col("listed").desc(), F.col("topic").isNull().desc(), F.col("n").desc(), "topic"]
    best = counts.withColumn("rank", F.row_number().over(by_period.orderBy(*order))).filter(F.col("rank") <= n + 1)
    # the first row of a period with lists is their counter, which has no topic
    has_list = F.max("listed").over(by_period)
    told = best.withColumn("_list", has_list).filter((F.col("listed") == F.col("_list")) & F.col("topic").isNotNull())
    place = F.col("rank") - F.col("_list").cast("int")
    return told.filter(place <= n).select("period_start", place.alias("rank"), "topic", "n")


def write_top_topics(counts: DataFrame, folder: str, state: str, n: int = 5, **trigger) -> StreamingQuery:
    """Start writing the ``n`` best topics of closed periods below ``folder``; ``state`` holds the stream's checkpoint.

    ``counts`` comes from `topic_count_stream`. All rows of a period leave the state in one micro-batch, which can therefore rank
    them. Each micro-batch has a folder of its own that a repetition after a failure overwrites: no period is lost or there
    twice. ``trigger`` is that of ``DataStreamWriter.trigger``; all that is there, once, by default.
    """

    def rank(batch: DataFrame, number: int) -> None:
        rank_closed(batch, n).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    # a stream without a file has no micro-batch, and its result is empty
    counts.sparkSession.createDataFrame([], TOP_TOPICS).write.mode("ignore").parquet(f"{folder}/batch=-1")
    writer = counts.writeStream.foreachBatch(rank).outputMode("append").option("checkpointLocation", state)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_top_topics(spark, folder: str) -> DataFrame:
    """What `write_top_topics` has written so far."""
    return spark.read.schema(TOP_TOPICS).parquet(folder).drop("batch")


def window_link_stream(
    documents: DataFrame, rows: DataFrame, before: str = "5 minutes", after: str = "5 minutes", time_column: str = "ts", delay: str = "10 minutes"
) -> DataFrame:
    """Time-window links between two streams; both watermarks bound the state.

    Inside the range both sides carry the same hour bucket or a neighbouring one, which gives Spark the equality it
    needs to hash-partition the state.
    """
    docs = documents.filter(F.col("ts").isNotNull()).select(F.col("id").alias("doc_id"), F.col("ts").cast("timestamp").alias("doc_time"))
    recs = rows.filter(F.col(time_column).isNotNull()).select("row_id", F.col(time_column).cast("timestamp").alias("row_time"))
    docs = docs.withWatermark("doc_time", delay)
    recs = recs.withWatermark("row_time", delay)
    low = F.col("doc_time") - F.expr(f"interval {before}")
    high = F.col("doc_time") + F.expr(f"interval {after}")
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    docs = docs.withColumn("_hour", F.explode(F.sequence(hour(low), hour(high))))
    recs = recs.withColumn("_hour", hour(F.col("row_time")))
    joined = docs.join(recs, (docs["_hour"] == recs["_hour"]) & (F.col("row_time") >= low) & (F.col("row_time") <= high))
    gap = (F.unix_micros("row_time") - F.unix_micros("doc_time")) / 1e6
    return joined.select("doc_id", "row_id", F.lit("time_window").alias("link_type"), gap.alias("gap"))
