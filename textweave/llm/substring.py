"""Substring dedup by hashing lines, cut further at sentence ends so that a passage need not fill whole lines.

Units are normalised (A-Z lowered, white space collapsed) and their digests grouped over the whole corpus. The earliest
occurrence by document and place stays; every other one is marked. Marked units that follow each other form a run, and a
run of ``min_words`` words or more is removed as one span of the original text, given by its offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textweave.llm.common import map_arrow, written

MIN_WORDS = 15
UNIT_END = {"sentence": re.compile(r"\n|[.!?][ \t]+"), "line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}


def units(text: str, unit: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units with a word; start and end are code points, ends include the separator."""
    out, at = [], 0
    ends = [m.end() for m in UNIT_END[unit].finditer(text)]
    for end in (*ends, len(text)):
        words = text[at:end].encode().lower().split()
        if words:
            out.append((at, end, len(words), xxhash.xxh3_128_digest(b" ".join(words))))
        at = end
    return out


def unit_rows(docs: DataFrame, unit: str) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos, start, stop, words) of every unit; null texts have none."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [units(t or "", unit) for t in part.column("text").to_pylist()]
                many = [len(x) for x in found]
                flat = [u for x in found for u in x]
                if not flat:
                    continue
                owner = pa.array(np.repeat(np.arange(len(found)), many))
                digest = np.frombuffer(b"".join(u[3] for u in flat), "<i8").reshape(-1, 2)
                numbers = np.array([u[:3] for u in flat], np.int32)
                pos = np.concatenate([np.arange(m, dtype=np.int32) for m in many])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), part.column("doc_id").take(owner), part.column("text_hash").take(owner),
                     pa.array(pos), *(pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(3))],
                    ["h1", "h2", "doc_id", "text_hash", "pos", "start", "stop", "words"],
                )

    kind = dict(source.dtypes)["doc_id"]
    return map_arrow(source, cut, f"h1 bigint, h2 bigint, doc_id {kind}, text_hash bigint, pos int, start int, stop int, words int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "sentence") -> DataFrame:
    """(doc_id, text_hash, start, stop, n_words, first_doc_id) of every span to remove.

    ``start`` and ``stop`` are code points of the original text, ``stop`` exclusive. ``first_doc_id`` holds the earliest
    copy of the span's first unit; it may be the same document. Earliest is by doc_id (null ids last), text hash, place.
    Rows with the same doc_id and text count as one document. Null, blank and unique texts have no spans.
    """
    if unit not in UNIT_END:
        raise ValueError(f"unit must be one of {sorted(UNIT_END)}")
    rows = unit_rows(docs, unit)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "pos")
    grouped = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
    # as many repeated units as the corpus has: a shuffled join at any size, whose hot digests Spark can split
    again = written(grouped.filter("n > 1").drop("n"), "repeated-units")
    marked = rows.join(again, ["h1", "h2"]).filter(rank != F.col("first"))
    marked = marked.select("doc_id", "text_hash", "pos", "start", "stop", "words", F.col("first")["doc_id"].alias("first_doc_id")).distinct()
    own = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    runs = marked.withColumn("run", F.col("pos") - F.row_number().over(own))
    spans = runs.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.min_by("first_doc_id", "pos").alias("first_doc_id")
    )
    return spans.filter(F.col("n_words") >= min_words).drop("run")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text``; other columns and texts without spans stay as they are."""
    lists = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    joined = docs.join(lists.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left")
    # what lies between one span's end and the next one's start
    starts = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["stop"]))
    ends = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length("text")))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    return joined.select(*[(F.when(F.col("_spans").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else docs[c]) for c in docs.columns])
