"""Pairs of texts within a share of edits, without a record per gram.

A text that is ``e`` edits away from a longer one keeps one of any ``e + 1`` disjoint pieces of it, the i-th of them with
no more than i edits before it and ``e - i`` behind it, so that it stands close to its old place. Texts are cut into blocks
by length. A block holds the pieces of its own texts; every text that may be the shorter one of a pair streams past it, and
what the pieces find is compared by small sketches. Only the texts themselves are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.session import ship

BLOCK_CHARS = 8_000_000  # characters of the longer texts that a task holds
CHARS_AT_ONCE = 500_000
MATCHES_AT_ONCE = 4_000_000
BITS = 512  # of a sketch: parities of hashed pairs of neighbouring characters, of which an edit changes four at most
LONG = 400  # characters from which sketches tell little; such pairs are compared by their grams
GRAM = 6
MIX = np.uint64(0x9E3779B97F4A7C15)


def edits(n, min_similarity: float):
    """Most edits of a text of ``n`` characters to a shorter one that is still similar."""
    return np.floor((1 - min_similarity) * np.asarray(n) + 1e-9).astype(np.int64)


class Texts:
    """Code points of a list of texts, in a row."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)

    def hashes(self, q: int) -> np.ndarray:
        """Hash of the ``q`` characters from each place on."""
        many = max(0, len(self.codes) - q + 1)
        out = np.zeros(many, np.uint64)
        for k in range(q):
            out = (out + self.codes[k : k + many] + np.uint64(1)) * MIX
            out ^= out >> np.uint64(29)
        return out

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash) of all grams within the texts."""
        many = np.maximum(0, self.size - q + 1)
        text = np.repeat(np.arange(len(many)), many)
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return text, place, self.hashes(q)[self.begin[text] + place] if len(text) else np.empty(0, np.uint64)

    def sketches(self) -> np.ndarray:
        """Parities of the hashed pairs of neighbours of each text, in words of 64 bits."""
        out = np.zeros((len(self.size), BITS // 64), np.uint64)
        text, _, code = self.grams(2)
        bit = (code * MIX >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
        for low in range(0, len(out), 8192):
            a, b = np.searchsorted(text, [low, low + 8192])
            rows = min(8192, len(out) - low)
            odd = np.bincount((text[a:b] - low) * BITS + bit[a:b], minlength=rows * BITS) & 1
            out[low : low + rows] = np.packbits(odd.astype(np.uint8).reshape(rows, BITS), axis=1).view(np.uint64)
        return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` (the last one first) and where equal keys begin in it."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


class Pieces:
    """Pieces of one length ``q`` of the longer texts, by hash. Equal pieces of a text are one entry with a range of places."""

    def __init__(self, texts: Texts, which: np.ndarray, most: np.ndarray, q: int):
        many = most[which] + 1
        text = np.repeat(which, many)
        number = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        place = number * texts.size[text] // (most[text] + 1)
        code = texts.hashes(q)[texts.begin[text] + place]
        order, first = _runs(text, code)
        self.q, self.least, self.longest = q, int((texts.size[which] - most[which]).min()), int(texts.size[which].max())
        self.text = text[order][first]
        self.size, self.edits = texts.size[self.text], most[self.text]
        self.low, self.high = np.minimum.reduceat(place[order], first), np.maximum.reduceat(place[order], first)
        self.early, self.late = np.minimum.reduceat(number[order], first), np.maximum.reduceat(number[order], first)
        self.code, self.start = np.unique(code[order][first], return_index=True)
        self.start = np.r_[self.start, len(self.text)]

    def met(self, short: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (short, longer text) that share a piece where it may stand; each once."""
        none = np.empty(0, np.int64)
        text, place, code = short.grams(self.q)
        fits = (short.size >= self.least) & (short.size <= self.longest)
        kept = fits[text]
        text, place, code = text[kept], place[kept], code[kept]
        if not len(code):
            return none, none
        order = np.argsort(code)
        at = np.empty(len(code), np.int64)
        at[order] = np.searchsorted(self.code, code[order])
        at = np.minimum(at, len(self.code) - 1)
        kept = self.code[at] == code
        text, place, at = text[kept], place[kept], at[kept]
        order, first = _runs(text, at)
        if not len(order):
            return none, none
        low, high = np.minimum.reduceat(place[order], first), np.maximum.reduceat(place[order], first)
        text, at = text[order][first], at[order][first]
        many = self.start[at + 1] - self.start[at]
        found = []
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // MATCHES_AT_ONCE)) + 1):
            m = many[own]
            entry = np.repeat(self.start[at[own]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            one = np.repeat(own, m)
            less = self.size[entry] - short.size[text[one]]
            near = (less >= 0) & (less <= self.edits[entry])
            entry, one, less = entry[near], one[near], less[near]
            before, behind = self.late[entry], self.edits[entry] - self.early[entry]
            near = (high[one] >= self.low[entry] - before) & (low[one] <= self.high[entry] + before)
            near &= (high[one] + less >= self.low[entry] - behind) & (low[one] + less <= self.high[entry] + behind)
            found.append(np.unique(text[one[near]] << 32 | self.text[entry[near]]))
        code = np.unique(np.concatenate(found))
        return code >> 32, code & 0xFFFFFFFF


class Block:
    """The longer texts of a block."""

    def __init__(self, texts: list[str], min_similarity: float):
        self.own = Texts(texts)
        self.edits = edits(self.own.size, min_similarity)
        q = np.where(self.edits > 0, self.own.size // (self.edits + 1), 0)
        self.pieces = [Pieces(self.own, np.flatnonzero(q == k), self.edits, int(k)) for k in np.unique(q[q > 0])]
        self.sketch = self.own.sketches()
        self.counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Pairs (shorter, longer) that may be similar, of ``texts`` and those of the block; no similar pair is missing."""
        short = Texts(texts)
        met = [pieces.met(short) for pieces in self.pieces]
        a, b = np.concatenate([m[0] for m in met] or [[]]).astype(np.int64), np.concatenate([m[1] for m in met] or [[]]).astype(np.int64)
        if not len(a):
            return [], []
        sketch = short.sketches()
        kept = [np.empty(0, np.int64)]
        for low in range(0, len(a), 1 << 18):
            i, j = a[low : low + (1 << 18)], b[low : low + (1 << 18)]
            differ = np.bitwise_count(sketch[i] ^ self.sketch[j]).sum(axis=1)
            kept.append(low + np.flatnonzero(differ <= 4 * self.edits[j]))
        kept = np.concatenate(kept)
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for i, j in zip(a[kept].tolist(), b[kept].tolist()):
            x, y = texts[i], self.own.texts[j]
            if (len(x), x) < (len(y), y) and (len(y) < LONG or self._share(own, i, x, j, y)):
                out.append((x, y))
        return [x for x, _ in out], [y for _, y in out]

    def _share(self, own: dict, i: int, x: str, j: int, y: str) -> bool:
        """Whether two texts share as many grams as ``edits`` leave of the longer one."""
        u, n = own.get(i) or own.setdefault(i, _counted(x))
        v, m = self.counted.get(j) or self.counted.setdefault(j, _counted(y))
        at = np.minimum(np.searchsorted(v, u), len(v) - 1)
        shared = np.minimum(n, m[at])[v[at] == u].sum()
        return shared >= len(y) - GRAM + 1 - GRAM * self.edits[j]


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(Texts([text]).hashes(GRAM), return_counts=True)


def lanes(sizes: list[tuple[int, int]], min_similarity: float, block_chars: int) -> tuple[list[tuple], int]:
    """(n, first block, blocks, blocks to pass as the shorter text) of each length ``n``, and how many blocks there are.

    ``sizes``: (length, texts of it). A block holds texts of neighbouring lengths, or a part of those of one length.
    """
    ranges, held = [], 0
    for n, many in sorted(sizes):
        if edits(n, min_similarity) < 1:
            continue  # similar to no shorter text
        if not ranges or held + n * many > block_chars:
            ranges.append([n, n, 1])
            held = 0
        held += n * many
        ranges[-1][1:] = n, -(-held // block_chars)
    first = np.cumsum([0, *[r[2] for r in ranges]]).tolist()
    out = []
    for n, _ in sizes:
        home = next(((first[k], r[2]) for k, r in enumerate(ranges) if r[0] <= n <= r[1] and edits(n, min_similarity) > 0), (None, None))
        # the longest partner has n / min_similarity characters; the least edits of a range are those of its shortest text
        past = [b for k, r in enumerate(ranges) if r[1] >= n and max(r[0], n) - edits(max(r[0], n), min_similarity) <= n for b in range(first[k], first[k + 1])]
        out.append((n, *home, past))
    return out, first[-1]


def near_pairs(texts: DataFrame, min_similarity: float, block_chars: int | None = None) -> DataFrame:
    """(short, long) of the different texts ``texts(t, n)``, ``n`` characters long, that may be ``min_similarity`` alike.

    ``texts`` is read twice and has each text once. Every similar pair is there once, and few others.
    """
    spark = texts.sparkSession
    ship(spark)
    sizes = [(r["n"], r["many"]) for r in texts.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()]  # one row per length
    listed, blocks = lanes(sizes, min_similarity, block_chars or BLOCK_CHARS)
    table = spark.createDataFrame(listed, "n int, home int, parts int, past array<int>")
    placed = texts.join(F.broadcast(table), "n")
    home = F.col("home") + F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
    held = placed.filter(F.col("home").isNotNull()).select(home.alias("block"), F.lit(0).alias("side"), "t")
    rows = held.unionByName(placed.select(F.explode("past").alias("block"), F.lit(1).alias("side"), "t"))
    dealt = rows.repartition(max(1, blocks), "block").sortWithinPartitions("block", "side")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, block, waiting, chars = None, [], None, [], 0

        def told() -> pa.RecordBatch:
            short, long = block.near(waiting)
            return pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array(long, pa.string())], ["short", "long"])

        for batch in batches:
            for b, side, t in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "t"))):
                if b != at:
                    if waiting:
                        yield told()
                    at, own, block, waiting, chars = b, [], None, [], 0
                if side == 0:
                    own.append(t)
                    continue
                block = block or Block(own, min_similarity)
                waiting.append(t)
                chars += len(t)
                if chars > CHARS_AT_ONCE:
                    yield told()
                    waiting, chars = [], 0
        if waiting:
            yield told()

    return dealt.mapInArrow(scan, "short string, long string")
