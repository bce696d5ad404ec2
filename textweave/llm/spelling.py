"""Spelling variants: words one inserted, deleted or replaced letter apart, found by an index of variable-length grams.

A word is padded at both ends and a gram is taken at each place: the shortest one of at least ``QMIN`` letters that is not
frequent, or ``QMAX`` letters. Frequent grams are kept in a dictionary, pruned at a share of all places, so its size has a
bound. A gram depends only on its own letters; one edit therefore affects at most as many grams as overlap at one place,
the word's bound, and of two grams that do not overlap at most one.

Every word is listed under (its length, place, gram). It looks itself up under its two rarest grams that do not overlap,
for words of its own length at the same place and for words one letter longer at the same and the next place. Lists are
merged by comparing gram sets, held as 64 bits: a partner may lack no more grams than each word's bound. What is left is
verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import map_arrow, pieces, written

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2  # a form is this many times as frequent as its variant
QMIN, QMAX = 2, 4
SHARE = 20_000  # a gram is frequent above one in so many places: at most so many frequent grams of each length
PLACES = 64  # a long word is looked up under grams that start in its first places
HELD = 200_000  # words or grams that a task counts before it passes them on
TEXT_CHARS = 1 << 20
ROWS = 4096  # words decomposed at once

# Fixed value: the letters of a word; only A-Z have been lower-cased before.
RUN = re.compile("[a-zÀ-ÿ]+")


def _counted(counts: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], [name, "n"])


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n) of every word of ``min_length`` letters and ``min_count`` occurrences in the whole texts of ``docs``.

    With ``typo_every``, a run whose crc32 of ``<doc_id>:<run>`` that number divides loses its letter crc32 % length first.
    Null, empty and letterless texts have no words; a null doc_id reads as nothing before the colon; repeated rows count
    again. Tasks count before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in pieces(text.as_py() or "", TEXT_CHARS):
                    for run, n in Counter(RUN.findall(part.encode().lower().decode())).items():
                        if len(run) < min_length:
                            continue
                        if typo_every:
                            h = zlib.crc32(run.encode(), prefix)
                            if h % typo_every == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                                if len(run) < min_length:
                                    continue
                        total[run] += n
                    if len(total) > HELD:
                        yield _counted(total, "word")
                        total.clear()
        yield _counted(total, "word")

    parts = map_arrow(docs.select("doc_id", "text"), count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, share: int = SHARE) -> dict[str, int]:
    """Counts of the frequent grams of ``qmin`` to ``qmax`` letters; at most ``share`` of each length."""
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                s = f"^{word}$"
                for q in range(qmin, qmax + 1):
                    total.update([s[p : p + q] for p in range(len(s) - q + 1)])
                if len(total) > HELD:
                    yield _counted(total, "gram")
                    total.clear()
        yield _counted(total, "gram")

    counts = map_arrow(words.select("word"), count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counts.filter(F.col("n") > F.lit(places / share)).collect()}


def decompose(padded: str, frequent: dict[str, int], qmin: int = QMIN, qmax: int = QMAX) -> list[str]:
    """The variable-length gram at each place of a padded word."""
    out, n = [], len(padded)
    for p in range(n - qmin + 1):
        end = p + qmin
        gram = padded[p:end]
        while end - p < qmax and end < n and gram in frequent:
            end += 1
            gram = padded[p:end]
        out.append(gram)
    return out


def affected(grams: list[str], n: int) -> int:
    """How many grams of a padded word of ``n`` letters one edit can touch at most."""
    edge = [0] * (n + 1)
    for p, gram in enumerate(grams):
        edge[p] += 1
        edge[p + len(gram)] -= 1
    most = depth = 0
    for e in edge:
        depth += e
        most = max(most, depth)
    return most


def rarest_apart(grams: list[str], frequent: dict[str, int]) -> tuple[int, int]:
    """Places of the two grams that do not overlap and are least frequent together; ties go to the first places."""
    order = sorted(range(min(len(grams), PLACES)), key=lambda p: (frequent.get(grams[p], 0), p))
    best = None
    for k, p in enumerate(order):
        n = frequent.get(grams[p], 0)
        if best and n >= best[0]:
            break
        for q in order[k + 1 :]:
            if p + len(grams[p]) <= q or q + len(grams[q]) <= p:
                both = n + frequent.get(grams[q], 0)
                if best is None or both < best[0]:
                    best = (both, p, q)
                break
    return best[1:]


def _listed(words: DataFrame, held, probe: bool) -> DataFrame:
    """(key, word, n, grams, bound): the index entries of all words, or what they look up."""
    places = PLACES + 1  # a gram may stand one place later in a longer word

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        code: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                keys, owner, sets, bounds = [], [], [], []
                for k, word in enumerate(part.column("word").to_pylist()):
                    padded = f"^{word}$"
                    n = len(padded)
                    grams = decompose(padded, frequent)
                    codes = []
                    for g in grams:
                        c = code.get(g)
                        if c is None:
                            c = code[g] = zlib.crc32(g.encode())
                        codes.append(c)
                    bits = 0
                    for c in codes:
                        bits |= 1 << (c & 63)
                    sets.append(bits - (1 << 64) if bits >> 63 else bits)
                    bounds.append(affected(grams, n))
                    # gram, length and place in one number; another gram with the same one only costs a comparison
                    if probe:
                        mine = []
                        for p in rarest_apart(grams, frequent):
                            c = codes[p] << 31
                            mine += [c | (n * 131 + p) & 0x7FFFFFFF, c | ((n + 1) * 131 + p) & 0x7FFFFFFF, c | ((n + 1) * 131 + p + 1) & 0x7FFFFFFF]
                    else:
                        mine = [c << 31 | (n * 131 + p) & 0x7FFFFFFF for p, c in enumerate(codes[:places])]
                    keys += mine
                    owner += [k] * len(mine)
                    if len(code) > HELD:
                        code.clear()
                take = pa.array(owner, pa.int32())
                columns = [part.column("word").take(take), part.column("n").take(take), pa.array(sets, pa.int64()).take(take), pa.array(bounds, pa.int32()).take(take)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)), *columns], ["key", "word", "n", "grams", "bound"])

    return map_arrow(words.select("word", "n"), emit, "key bigint, word string, n bigint, grams bigint, bound int")


def near_words(words: DataFrame, share: int = SHARE) -> DataFrame:
    """(word, n, other, other_n), both ways, for all pairs of ``words`` (word, n) that differ by exactly one edit.

    ``words`` is a written table of distinct words; those of fewer than ``QMAX`` letters, null or empty have no pair.
    """
    spark = words.sparkSession
    words = words.filter(F.length("word") >= QMAX)
    held = spark.sparkContext.broadcast(gram_dictionary(words, share=share))  # at most 3 * share grams
    listed, looked = _listed(words, held, probe=False).alias("i"), _listed(words, held, probe=True).alias("p")
    lacks = lambda a, b: F.bit_count(F.col(f"{a}.grams").bitwiseAND(F.bitwise_not(f"{b}.grams"))) <= F.col(f"{a}.bound")
    later = F.struct(F.length("i.word"), "i.word") > F.struct(F.length("p.word"), "p.word")
    one = F.levenshtein("p.word", "i.word", 1) == 1
    # a word has many entries on both sides, of which its table's size tells nothing: neither side is broadcast
    found = looked.join(listed.hint("merge"), (F.col("p.key") == F.col("i.key")) & later & lacks("p", "i") & lacks("i", "p") & one)
    pairs = found.select(F.col("p.word").alias("a"), F.col("p.n").alias("an"), F.col("i.word").alias("b"), F.col("i.n").alias("bn")).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("other_n"))))
    return pairs.select(both.alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers are doubled until nothing moves. Forms lead to ever more frequent words."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        stepped = written(at.join(up.hint("merge"), "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        at = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO, share: int = SHARE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n).

    A word's form is its most frequent near word (ties: the smallest by code point) if that is at least ``ratio`` times as
    frequent, else null; the root is where following forms ends, the word itself without a form. No words give no rows.
    """
    words = written(words.select("word", "n"), "words")
    best = near_words(words, share).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    )
    known = words.join(best.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.less"))
    judged = known.withColumn("formed", F.col("form_n") >= ratio * F.col("n"))
    near = written(
        judged.select(
            "word", F.when(F.col("formed"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("formed"), F.col("form_n")).alias("form_n"),
        ),
        "near-words",
    )
    ends = roots(near.filter(F.col("form").isNotNull()))
    return near.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
