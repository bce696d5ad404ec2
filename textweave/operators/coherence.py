"""Coherence of topics: how often a topic's words stand near each other in the corpus (Roeder, Both and Hinneburg, 2015)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweave.session import ship

CORPUS_WINDOW = 110  # fixed value: tokens of the sliding window
EPSILON = 1e-12  # fixed value: added to joint probabilities
HITS_AT_ONCE = 100_000  # places of topic words worked on at once


def numbered(words: DataFrame) -> DataFrame:
    """(topic, bit, word): a topic's words numbered by rank from 0."""
    return words.select("topic", "word", (F.row_number().over(Window.partitionBy("topic").orderBy("rank", "word")) - 1).alias("bit"))


def _joint(doc: np.ndarray, topic: np.ndarray, bit: np.ndarray, pos: np.ndarray, last: np.ndarray, window: int, topics: int, width: int) -> np.ndarray:
    """topics x width x width counts of the windows that hold both words; hits come sorted by doc, topic, bit, pos."""
    first = np.maximum(pos - (window - 1), 0)
    stop = np.minimum(pos, last) + 1
    same = (doc[1:] == doc[:-1]) & (topic[1:] == topic[:-1]) & (bit[1:] == bit[:-1])
    stop[:-1] = np.where(same, np.minimum(stop[:-1], first[1:]), stop[:-1])  # the next hit of the word takes over
    live = stop > first
    doc, topic, bit, first, stop = (x[live] for x in (doc, topic, bit, first, stop))
    doc, topic, bit, at = np.r_[doc, doc], np.r_[topic, topic], np.r_[bit, bit], np.r_[first, stop]
    order = np.lexsort((at, topic, doc))
    step = np.zeros((len(at), width), np.int8)
    step[np.arange(len(at)), bit] = np.r_[np.ones(len(first), np.int8), -np.ones(len(stop), np.int8)]
    held = np.cumsum(step[order], axis=0, dtype=np.int32)
    doc, topic, at = doc[order], topic[order], at[order]
    length = np.zeros(len(at))
    length[:-1] = np.where((doc[1:] == doc[:-1]) & (topic[1:] == topic[:-1]), at[1:] - at[:-1], 0)
    out = np.zeros((topics, width, width))
    for t in np.unique(topic):
        own = (topic == t) & (length > 0)
        there = held[own].astype(np.float64)
        out[t] += there.T @ (there * length[own, None])
    return out


def window_counts(words: DataFrame, lemmas: DataFrame, window: int = CORPUS_WINDOW, tokens: str = "lemmas") -> DataFrame:
    """(topic, a, b, n, windows): in how many of all ``windows`` the topic's words number a and b (a <= b) stand together.

    A word's windows are intervals of starting places, kept inside the record; a batch of documents leaves one count per
    topic and pair of its words. A text shorter than the window is one window; empty and null texts have none. The words
    of the topics are held by every task: a few for each topic.
    """
    spark = lemmas.sparkSession
    listed = numbered(words)
    rows = listed.collect()  # n words for each topic
    names = sorted({r.topic for r in rows}, key=str)
    place = {t: i for i, t in enumerate(names)}
    vocabulary = sorted({r.word for r in rows})
    owners = {w: [] for w in vocabulary}
    for r in rows:
        owners[r.word].append((place[r.topic], r.bit))
    start = np.r_[0, np.cumsum([len(owners[w]) for w in vocabulary])].astype(np.int64)
    of_topic, of_bit = (np.array([o[k] for w in vocabulary for o in owners[w]], np.int64) for k in (0, 1))
    width = max((r.bit for r in rows), default=0) + 1
    wanted = pa.array(vocabulary, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = np.zeros((len(names), width, width)), 0
        for batch in batches:
            lists = batch.column(0)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            begin = np.cumsum(size) - size
            last = np.maximum(size - window, 0)
            windows += int((last[size > 0] + 1).sum())
            found = pc.fill_null(pc.index_in(flat, wanted), -1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(found >= 0)
            doc = np.searchsorted(begin, at, "right") - 1
            part = np.searchsorted(doc, doc) // HITS_AT_ONCE  # a document's hits stay together
            for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                if not len(own):
                    continue
                word, d = found[at[own]], doc[own]
                many = start[word + 1] - start[word]
                member = np.repeat(start[word], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                d, p = np.repeat(d, many), np.repeat(at[own] - begin[d], many)
                t, b = of_topic[member], of_bit[member]
                order = np.lexsort((p, b, t, d))
                total += _joint(d[order], t[order], b[order], p[order], last[d[order]], window, len(names), width)
        t, a, b = np.nonzero(np.triu(np.ones((width, width), bool))[None] & (total > 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[t, -1]), pa.array(np.r_[a, 0]), pa.array(np.r_[b, 0]), pa.array(np.r_[total[t, a, b], windows].astype(np.int64))], ["t", "a", "b", "n"]
        )

    ship(spark)
    summed = lemmas.select(tokens).mapInArrow(count, "t bigint, a bigint, b bigint, n bigint").groupBy("t", "a", "b").agg(F.sum("n").alias("n"))
    # at most one row per topic and pair of words from here on
    named = spark.createDataFrame(list(enumerate(names)), f"t bigint, topic {dict(words.dtypes)['topic']}")
    all_windows = summed.filter("t < 0").select(F.col("n").alias("windows"), F.lit(1).alias("_k"))
    return summed.join(F.broadcast(named), "t").withColumn("_k", F.lit(1)).join(F.broadcast(all_windows), "_k").select("topic", "a", "b", "n", "windows")


def _npmi(joint: Column, a: Column, b: Column) -> Column:
    j = joint + EPSILON
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.log(j / (a * b)) / -F.log(j))


def pair_npmi(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(topic, a, b, npmi) for every ordered pair of a topic's words, also a word and itself."""
    bits = numbered(words).select("topic", F.col("bit").cast("bigint").alias("bit"))
    single = counts.filter("a = b").select("topic", F.col("a").alias("bit"), (F.col("n") / F.col("windows")).alias("p"))
    known = bits.join(single, ["topic", "bit"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    side = lambda c: known.select("topic", F.col("bit").alias(c), F.col("p").alias(f"p_{c}"))
    joint = counts.select("topic", F.col("a").alias("low"), F.col("b").alias("high"), (F.col("n") / F.col("windows")).alias("p"))
    pairs = side("a").join(side("b"), "topic").withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    met = pairs.join(joint, ["topic", "low", "high"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return met.select("topic", "a", "b", _npmi(F.col("p"), F.col("p_a"), F.col("p_b")).alias("npmi"))


def coherence(words: DataFrame, lemmas: DataFrame, window: int = CORPUS_WINDOW, tokens: str = "lemmas") -> DataFrame:
    """(topic, npmi): mean normalised pointwise mutual information of the pairs of a topic's words (topic, rank, word)."""
    pairs = pair_npmi(words, window_counts(words, lemmas, window, tokens))
    return pairs.filter("a < b").groupBy("topic").agg(F.avg("npmi").alias("npmi"))


def coherence_cv(words: DataFrame, lemmas: DataFrame, window: int = CORPUS_WINDOW, tokens: str = "lemmas") -> DataFrame:
    """(topic, c_v): each word's vector of NPMI with all words of its topic, and the mean of the cosines between these
    vectors and their sum. A word that never occurs has a zero vector and cosine 0."""
    pairs = pair_npmi(words, window_counts(words, lemmas, window, tokens))
    whole = pairs.groupBy("topic", "b").agg(F.sum("npmi").alias("v"))
    cells = pairs.join(whole, ["topic", "b"])
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    angles = cells.groupBy("topic", "a").agg(F.sum(F.col("npmi") * F.col("v")).alias("dot"), length("npmi").alias("u"), length("v").alias("s"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.col("u") * F.col("s")), F.lit(0.0))
    return angles.groupBy("topic").agg(F.avg(cosine).alias("c_v"))
