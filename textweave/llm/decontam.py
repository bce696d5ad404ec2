"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Token hashes and the hashes of all runs of ``min_match`` tokens are rolled over a whole batch of texts at once. Runs that
also occur in a benchmark item are the seeds that join a document with an item. For each such pair the longest common
runs are marked first, never overlapping, until none of ``min_match`` tokens is left; marks may lie in any order, so
reordered passages count. A document is contaminated if its tiles cover at least ``min_coverage`` of an item's tokens. An
item of fewer than ``min_tokens`` tokens is one required tile: it is found where all its tokens stand in a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import map_arrow, written
from textweave.llm.wordhash import WordHash, word_spans

MIN_MATCH = 5
MIN_COVERAGE = 0.5
MIN_TOKENS = 8
BLOCK_BYTES = 16 << 20  # of benchmark text held by a task at once
TEXT_BYTES = 4 << 20  # of document text hashed at once

RUN = np.uint64(0xD1B54A32D192ED03)  # of token hashes, which are random already
WORDS = WordHash(7, fold_case=True)


def token_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in a byte array; A-Z count as a-z."""
    start, end = word_spans(data)
    return WORDS(data, start, end), start


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` tokens; runs that cross from one text to the next are the caller's to drop."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * RUN + tokens[k : k + n]
    return out


def tile(text: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, length) of two token arrays, longest first."""
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    places = defaultdict(list)
    for j, h in enumerate(run_hashes(item, min_match).tolist()):
        places[h].append(j)
    runs = run_hashes(text, min_match)
    seeds = [(int(i), j) for i in np.flatnonzero(np.isin(runs, np.fromiter(places, np.uint64, len(places)))) for j in places[int(runs[i])]]
    tiles = []
    while seeds:
        best, matches, left = 0, [], []
        seen: dict[int, tuple[int, int]] = {}  # per diagonal, the last match that was walked
        for i, j in seeds:
            if not (free_t[i : i + min_match].all() and free_i[j : j + min_match].all()):
                continue
            left.append((i, j))
            walked = seen.get(i - j)
            if walked and i < walked[1]:
                continue  # inside a match that began earlier on this diagonal
            n = 0
            while i + n < len(text) and j + n < len(item) and free_t[i + n] and free_i[j + n] and text[i + n] == item[j + n]:
                n += 1
            seen[i - j] = (i, i + n)
            if n >= min_match:
                matches.append((n, i, j))
                best = max(best, n)
        seeds = left
        if best < min_match:
            break
        for n, i, j in matches:
            if n == best and free_t[i : i + n].all() and free_i[j : j + n].all():
                free_t[i : i + n] = False
                free_i[j : j + n] = False
                tiles.append((i, j, n))
    return tiles


class Items:
    """Benchmark items of one block: token hashes, and the seeds that lead to them by their length."""

    def __init__(self, rows: list[tuple], min_match: int, min_tokens: int):
        self.ids, self.tokens, self.whole = [], [], []
        for item_id, text in rows:
            tokens, _ = token_hashes(np.frombuffer((text or "").encode(), np.uint8))
            if len(tokens):
                self.ids.append(item_id)
                self.tokens.append(tokens)
                self.whole.append(len(tokens) < min_tokens)
        length = np.array([len(t) if w else min_match for t, w in zip(self.tokens, self.whole)], np.int64)
        self.seeds = {}
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            runs = [np.unique(run_hashes(self.tokens[i], n)) for i in own]
            seeds, at = np.concatenate(runs), np.repeat(own, [len(r) for r in runs])
            order = np.argsort(seeds, kind="stable")
            self.seeds[n] = seeds[order], at[order]

    def found(self, runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in runs of ``length`` tokens, item) for every seed that occurs."""
        seeds, at = self.seeds[length]
        low, high = np.searchsorted(seeds, runs, "left"), np.searchsorted(seeds, runs, "right")
        many = high - low
        place = np.repeat(np.arange(len(runs)), many)
        return place, at[np.repeat(low, many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]


def contaminations(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, min_tokens: int = MIN_TOKENS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, tiles, item_tokens) for every document and item with ``min_coverage`` or more.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. ``tiles`` lists (token in document, token in item,
    tokens) of each match; ``item_tokens`` is the length of the item. The benchmark is a query set: it is read in blocks of about ``block_bytes`` that tasks hold
    whole, each block against all documents. Null and blank texts match nothing; items with fewer than ``min_tokens``
    tokens are looked for whole (coverage 1, the first place in the document as the tile). Repeated documents are each reported, repeated items under their own ids. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    whole = dict(benchmark.dtypes)["item_id"] in ("tinyint", "smallint", "int")
    items = benchmark.select(F.col("item_id").cast("bigint") if whole else "item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    min_tokens = max(min_tokens, min_match)
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    types = dict(source.dtypes) | {"item_id": dict(items.dtypes)["item_id"]}
    schema = f"doc_id {types['doc_id']}, text_hash bigint, item_id {types['item_id']}, coverage double, tiles array<struct<text_at:int,item_at:int,length:int>>, item_tokens int"

    def search(block: int) -> DataFrame:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        held = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(held.value, min_match, min_tokens)
            out_type = None
            for batch in batches:
                texts = batch.column("text").to_pylist()
                hits = []
                at = 0
                while at < len(texts):  # some megabytes of text at a time
                    end, size = at, 0
                    while end < len(texts) and (end == at or size < TEXT_BYTES):
                        size += len(texts[end] or "")
                        end += 1
                    hits += [(at + d, *rest) for d, *rest in leaks([(t or "").encode() for t in texts[at:end]], known)]
                    at = end
                if hits:
                    out_type = out_type or pa.list_(pa.struct([("text_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())]))
                    own = pa.array([h[0] for h in hits])
                    tiles = [[{"text_at": i, "item_at": j, "length": n} for i, j, n in h[3]] for h in hits]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(own), batch.column("text_hash").take(own), pa.array([h[1] for h in hits]),
                         pa.array([h[2] for h in hits], pa.float64()), pa.array(tiles, out_type), pa.array([h[4] for h in hits], pa.int32())],
                        ["doc_id", "text_hash", "item_id", "coverage", "tiles", "item_tokens"],
                    )

        def leaks(texts: list[bytes], known: Items) -> list[tuple]:
            data = np.frombuffer(b"\n".join(texts), np.uint8)
            tokens, start = token_hashes(data)
            sizes = np.array([len(t) + 1 for t in texts])
            first = np.searchsorted(start, np.r_[0, np.cumsum(sizes)])  # first token of each text
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            out = []
            for length in known.seeds:
                place, item = known.found(run_hashes(tokens, length), length)
                inside = owner[place] == owner[place + length - 1]
                pairs, at = np.unique(np.stack([owner[place[inside]], item[inside]], axis=1), axis=0, return_index=True)
                for (d, i), start_at in zip(pairs.tolist(), place[inside][at].tolist()):
                    target = known.tokens[i]
                    if known.whole[i]:
                        tiles = [(start_at - int(first[d]), 0, length)]
                    else:
                        tiles = tile(tokens[first[d] : first[d + 1]], target, min_match)
                    coverage = sum(n for _, _, n in tiles) / len(target)
                    if coverage >= min_coverage:
                        out.append((d, known.ids[i], coverage, tiles, len(target)))
            return out

        return map_arrow(source, scan, schema)

    found = search(0)
    for block in range(1, blocks):
        found = found.unionByName(search(block))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, **settings) -> DataFrame:
    """``docs`` without the contaminated rows, with the same columns.

    Only items of at least ``min_tokens`` tokens take documents away: a question of a word or two stands in many documents
    that never saw the benchmark. ``contaminations`` reports the shorter ones.
    """
    found = contaminations(docs, benchmark, min_tokens=min_tokens, **settings).filter(F.col("item_tokens") >= min_tokens)
    leaks = written(found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    # ids are the small side; texts are dealt by document but not sorted
    return docs.join(leaks.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(leaks["_doc"]) & (F.xxhash64(docs["text"]) == leaks["_hash"]), "left_anti")
