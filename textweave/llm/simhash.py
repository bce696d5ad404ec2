"""SimHash near-dedup with pigeonring candidates.

Fingerprints of 64 bits are cut into m > k segments in a ring. Two fingerprints within k bits have a segment from which
every chain of l consecutive segments differs in at most floor(l * k / m) bits. With m = k + 1 the first segment of the
chain is equal and the second differs in one bit at most, which makes a bucket key of two segments: each fingerprint
stands in the bucket of its own key and visits those with one bit of the second segment cleared (a pair that differs
there meets in the bucket of the cleared bit). Longer chains and then the full distance are checked in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import map_arrow, shuffle_width, sized_broadcast, written
from textweave.llm.components import connected_components

BITS = 64
SEED = 42
BUCKET = 1024  # rows of one side that meet in one piece of a bucket
PAIRS = 1 << 21  # pairs compared at once in a task
HOT_BROADCAST = 500_000


# -- fingerprints --------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64; no words give 0."""
    plain = b" ".join((text or "").encode().lower().split())  # bytes: A-Z only, and exactly the ASCII white space
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= words:
        return xxhash.xxh64_intdigest(plain, SEED)
    starts = np.concatenate([[0], gaps + 1])[: n - words + 1].tolist()
    ends = np.concatenate([gaps, [len(plain)]])[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 18):
        pairs = zip(starts[at : at + (1 << 18)], ends[at : at + (1 << 18)])
        hashes = np.array([digest(plain[s:e], SEED) for s, e in pairs], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * set_bits > len(starts))))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) per row of ``docs``; null or blank texts have fingerprint 0."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])

    kind = dict(source.dtypes)["doc_id"]
    return map_arrow(source, add, f"doc_id {kind}, text_hash bigint, fp bigint")


# -- candidates ----------------------------------------------------------------------------------------------------


class Ring:
    """Segments of a fingerprint in a ring, with masks and budgets of the chains that start at each."""

    def __init__(self, most: int):
        self.m = most + 1
        edges = [round(BITS * i / self.m) for i in range(self.m + 1)]
        self.low, self.width = edges[:-1], [b - a for a, b in zip(edges, edges[1:])]
        self.masks = [((1 << w) - 1) << low for low, w in zip(self.low, self.width)]
        self.most = most

    def chain(self, start: int, length: int) -> int:
        return sum(self.masks[(start + j) % self.m] for j in range(length))

    def budget(self, length: int) -> int:
        return length * self.most // self.m

    def keys(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, visits, fp) rows of an array of fingerprints: own buckets, and those with one bit cleared."""
        key, visits, own = [], [], []
        for i in range(self.m):
            second = self.masks[(i + 1) % self.m]
            pair = fp & np.uint64(self.masks[i] | second)
            variants = [(pair, np.ones(len(fp), bool), False)]
            for bit in range(BITS):
                if second >> bit & 1:
                    one = np.uint64(1 << bit)
                    variants.append((pair & ~one, (fp & one) != 0, True))
            for value, there, visitor in variants:
                value = value[there]
                # the two segments side by side, then the number of the chain's start
                a = (value & np.uint64(self.masks[i])) >> np.uint64(self.low[i])
                b = (value & np.uint64(second)) >> np.uint64(self.low[(i + 1) % self.m])
                packed = (np.uint64(i) << np.uint64(56)) | (a << np.uint64(self.width[(i + 1) % self.m])) | b
                key.append(packed)
                visits.append(np.full(len(value), visitor))
                own.append(fp[there])
        return np.concatenate(key), np.concatenate(visits), np.concatenate(own)

    def close(self, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs keep every chain budget from their start segment on, and so the full distance."""
        left = np.arange(len(a))
        for length in range(1, self.m + 1):
            masks = np.array([self.chain(i, length) for i in range(self.m)], np.uint64)
            differing = np.bitwise_count((a[left] ^ b[left]) & masks[start[left]])
            left = left[differing <= self.budget(length)]
        return left


def bucket_rows(distinct: DataFrame, most: int) -> DataFrame:
    """(key, visits, fp): the rows that distinct fingerprints ``fp`` put into buckets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(most)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key, visits, own = ring.keys(fp)
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part].view(np.int64)), pa.array(visits[part]), pa.array(own[part].view(np.int64))], ["key", "visits", "fp"]
                )

    return map_arrow(distinct.select("fp"), emit, "key bigint, visits boolean, fp bigint")


# A bucket has members (rows of its own key) and visitors. Roles in a piece of it, in sorting order:
MEMBER, BLOCK, PROBE = 0, 1, 2  # compared with members too; compared with probes only; compared with the former two


def pieces(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, piece, role, fp): buckets of more than ``bucket`` members or visitors cut into a grid of blocks.

    Every member meets every other member and every visitor in exactly one piece.
    """
    counted = rows.groupBy("key").agg(F.count_if(~F.col("visits")).alias("members"), F.count_if("visits").alias("visitors"))
    hot = counted.filter((F.col("members") > bucket) | ((F.col("members") > 0) & (F.col("visitors") > bucket)))
    hot = hot.select("key", F.ceil(F.col("members") / bucket).cast("int").alias("nb"), F.greatest(F.lit(1), F.ceil(F.col("visitors") / bucket)).cast("int").alias("nv"))
    # visitors of an empty bucket meet nobody; where such a bucket is large they must not gather in one task either
    idle = counted.filter((F.col("members") == 0) & (F.col("visitors") > bucket)).select("key", F.lit(0).alias("nb"), F.lit(0).alias("nv"))
    hot = sized_broadcast(written(hot.unionByName(idle), "hot-buckets"), HOT_BROADCAST)
    joined = rows.join(hot, "key", "left")
    salt = F.xxhash64("fp")
    block, chunk = F.pmod(salt, F.col("nb")).cast("int"), F.pmod(salt, F.col("nv")).cast("int")
    cell = lambda piece, role: F.struct(piece.cast("int").alias("piece"), F.lit(role).alias("role"))
    grid = lambda i, j: i * F.col("nb") + j + 1
    visited = lambda i, c: -(i * F.col("nv") + c + 1)
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    member = F.flatten(F.array(
        F.array(cell(grid(block, block), MEMBER)),
        F.transform(F.filter(spread(F.col("nb")), lambda j: j > block), lambda j: cell(grid(block, j), BLOCK)),
        F.transform(F.filter(spread(F.col("nb")), lambda i: i < block), lambda i: cell(grid(i, block), PROBE)),
        F.transform(spread(F.col("nv")), lambda c: cell(visited(block, c), BLOCK)),
    ))
    cells = (
        F.when(F.col("nb").isNull(), F.array(F.when(F.col("visits"), cell(F.lit(0), PROBE)).otherwise(cell(F.lit(0), MEMBER))))
        .when(F.col("nb") == 0, F.array().cast("array<struct<piece:int,role:int>>"))
        .when(F.col("visits"), F.transform(spread(F.col("nb")), lambda i: cell(visited(i, chunk), PROBE)))
        .otherwise(member)
    )
    return joined.select("key", "fp", F.inline(cells))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the pairs connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        new = new[root]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            away = root != np.arange(len(nodes))
            return nodes[root[away]], nodes[away]
        root = new


def linked(key: np.ndarray, piece: np.ndarray, role: np.ndarray, fp: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside whole pieces, which come sorted by key, piece and role."""
    n = len(key)
    first = np.r_[True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]
    start = np.flatnonzero(first)
    unit = np.cumsum(first) - 1
    indexed = np.add.reduceat((role != PROBE).astype(np.int64), start)  # members and blocks stand first in their piece
    place = np.arange(n) - start[unit]
    partners = np.where(role == PROBE, indexed[unit], np.where(role == MEMBER, place, 0))
    rows = np.flatnonzero(partners)
    found_a, found_b = [], []
    upto = np.cumsum(partners[rows])
    at = 0
    while at < len(rows):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        own, many = rows[at:end], partners[rows[at:end]]
        left = np.repeat(own, many)
        right = np.repeat(start[unit[own]], many) + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        near = ring.close((key[left] >> np.uint64(56)).astype(np.int64), fp[left], fp[right])
        if len(near):
            a, b = forest(fp[left[near]], fp[right[near]])
            found_a.append(a)
            found_b.append(b)
        at = end
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, most: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect exactly what pairs of fingerprints within ``most`` bits connect."""
    rows = pieces(bucket_rows(distinct, most), bucket)
    dealt = rows.repartition(shuffle_width(distinct.sparkSession), "key", "piece").sortWithinPartitions("key", "piece", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, held = Ring(most), []

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = linked(*parts, ring)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held)]

        for batch in batches:
            key, piece, role, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "piece", "role", "fp"))
            held.append([key.view(np.uint64), piece, role, fp.view(np.uint64)])
            if sum(len(h[0]) for h in held) < 1 << 16:
                continue
            parts = joined()
            last = np.flatnonzero((parts[0] != parts[0][-1]) | (parts[1] != parts[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:  # the last piece may go on in the next batch
                yield out([p[:cut] for p in parts])
            held = [[p[cut:] for p in parts]]
        if held and sum(len(h[0]) for h in held):
            yield out(joined())

    return map_arrow(dealt, compare, "a bigint, b bigint")


# -- the operator --------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of ``docs`` (doc_id, text); root names the component too.

    Rows whose fingerprints differ in at most ``most`` bits are linked, component_id is the smallest doc_id reachable.
    Null and blank texts have fingerprint 0 and link like any other. Null doc_ids take part; a component of nothing but
    null ids has a null component_id. Repeated rows come back as often as they came. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = connected_components(links(distinct, most, bucket))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = written(rooted.join(low, "root").select("fp", "root", "component_id"), "component-ids")
    return prints.join(ids, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 5, most: int = 4, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (a null id counts as the largest)."""
    found = written(near_duplicates(docs, words, most, bucket), "near-duplicates")
    entry = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(entry).alias("best"))
    same_row = found.groupBy("doc_id", "text_hash", "root").agg(F.count(F.lit(1)).alias("copies"))
    # written apart, so that the join's copies of one group can be split or the smaller side be sent to all
    best = sized_broadcast(written(best, "best-of-component"), HOT_BROADCAST)
    marked = same_row.join(best, "root").select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "copies", (entry == F.col("best")).alias("stays")
    )
    marked = written(marked, "near-duplicate-marks")
    at = lambda m: docs["doc_id"].eqNullSafe(m["_doc"]) & (F.xxhash64(docs["text"]) == m["_hash"])
    # the ids are the small side; texts are dealt by document but not sorted
    gone = marked.filter(~F.col("stays")).hint("shuffle_hash")
    left = docs.join(gone, at(gone), "left_anti")
    repeated = marked.filter("stays AND copies > 1")
    if repeated.isEmpty():
        return left
    twice = F.broadcast(repeated) if repeated.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST else repeated
    once = docs.join(twice, at(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, at(twice), "left_anti").unionByName(once)
