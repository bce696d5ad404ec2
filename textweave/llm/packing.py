"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces no longer than the largest permitted sequence, dealt at random into groups of a bounded
number of tokens, and packed group by group, longest piece first: a piece goes into the open bin with the least room that
still holds it; where none does, a bin of the size chosen for pieces of its length is opened. At the end every bin is cut down
to the smallest permitted size that holds its contents. Which size pieces of a length open is chosen for the whole group:
the group is packed ahead with each size, and the one that costs least in the end, all bins and cuts counted, stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import map_arrow, written
from textweave.llm.tokens import VOCABULARY, encoder

SIZES = (512, 1024, 2048, 4096)
GROUP_TOKENS = 4_000_000
QUARTERS = 4  # classes of lengths between two sizes


def size_cost(size: int) -> float:
    """Cost of one sequence: linear work plus attention, which grows with the square."""
    return size * (1 + size / 32768)


def token_lengths(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_hash, n_tokens) of each row's whole text, one end token included; null texts count as empty."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = encoder(file).encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(at) + 1)], ["doc_id", "text_hash", "n_tokens"])

    return map_arrow(source, count, f"doc_id {dict(source.dtypes)['doc_id']}, text_hash bigint, n_tokens bigint")


def pack(lengths: list[int], sizes: tuple[int, ...], cost=size_cost, opens=None) -> tuple[list[int], list[int]]:
    """(bin of each piece, size of each bin) for pieces of at most max(sizes) tokens; equal inputs, equal bins.

    ``opens(n)`` is the size of the bin that a piece of n tokens opens; without it, the one with the least cost per token
    if all room could be filled, which is the smallest that holds the piece.
    """
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    left = sum(lengths)  # tokens not yet packed
    room_bins: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # bins by the room they have
    rooms = 0  # bit r is set if some bin has room r
    bins: list[int] = [0] * len(lengths)
    used: list[int] = []
    for k in order:
        n = lengths[k]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = room_bins[room].pop()
            if not room_bins[room]:
                rooms &= ~(1 << room)
        else:
            room = opens(n) if opens else min((s for s in sizes if s >= n), key=lambda s: (cost(s) / max(1, min(s, left)), s))
            b = len(used)
            used.append(0)
        bins[k] = b
        used[b] += n
        left -= n
        if room > n:
            room_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, [next(s for s in sizes if s >= u) for u in used]


def pack_ahead(lengths: list[int], sizes: tuple[int, ...], cost=size_cost) -> tuple[list[int], list[int]]:
    """``pack`` with the opening size of every class of lengths chosen by packing all pieces ahead with each size.

    A class is a quarter of the way from one size to the next. Classes are settled one after the other, long pieces first;
    a choice stays if all bins cost less than before, so the result never costs more than the smallest sizes.
    """
    sizes = tuple(sorted(sizes))
    bounds = sorted({p + (s - p) * j // QUARTERS for p, s in zip((0, *sizes), sizes) for j in range(1, QUARTERS + 1)})
    opening = [next(s for s in sizes if s >= b) for b in bounds]
    opens = lambda n: opening[bisect_left(bounds, n)]
    total = lambda packed: sum(cost(s) for s in packed[1])
    best = pack(lengths, sizes, cost, opens)
    least = total(best)
    for c in sorted({bisect_left(bounds, n) for n in set(lengths)}, reverse=True):
        kept = opening[c]
        for s in sizes[sizes.index(kept) + 1 :]:
            opening[c] = s
            tried = pack(lengths, sizes, cost, opens)
            if (now := total(tried)) < least:
                best, least, kept = tried, now, s
        opening[c] = kept
    return best


def packed_sequences(
    lengths: DataFrame, sizes: tuple[int, ...] = SIZES, group_tokens: int = GROUP_TOKENS, cost=size_cost
) -> DataFrame:
    """(doc_id, text_hash, piece, first_token, n_tokens, bin_id, bin_size, bin_offset) for each piece of each document.

    ``lengths`` is a written table as ``token_lengths`` gives it. Every token of every document is in exactly one piece;
    pieces other than a document's last have max(sizes) tokens. Rows with a null or non-positive length have no piece.
    Repeated rows are packed each for itself. ``bin_id`` is unique; ``bin_offset`` is the place in the bin. The number of
    groups follows the tokens, so that no task holds more than about ``group_tokens``.
    """
    longest = max(sizes)
    total = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    groups = int(total // group_tokens) + 1
    # a number of each row of the written table, so that repeats of a row go to different groups
    numbered = lengths.withColumn("row", F.monotonically_increasing_id()).filter(F.col("n_tokens") > 0)
    cut = numbered.select(
        "doc_id", "text_hash", "row", F.col("n_tokens").alias("_n"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / longest) - 1).cast("int"))).alias("piece")
    )
    first = F.col("piece").cast("bigint") * longest
    pieces = cut.select("doc_id", "text_hash", "row", "piece", first.alias("first_token"), F.least(F.lit(longest), F.col("_n") - first).cast("int").alias("n_tokens"))
    # groups by a hash of row and piece: one document, one source or one repeated row never decides a group
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int")).drop("row")
    dealt = grouped.repartition(groups, "grp").sortWithinPartitions("grp", F.col("n_tokens").desc(), "doc_id", "text_hash", "piece")
    kind = dict(lengths.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash bigint, piece int, first_token bigint, n_tokens int, bin_id bigint, bin_size int, bin_offset int"

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.column("n_tokens").to_pylist()
        grp = table.column("grp")[0].as_py()
        bins, size = pack_ahead(n, sizes, cost)
        fill = [0] * len(size)
        offset = []
        for k, b in enumerate(bins):
            offset.append(fill[b])
            fill[b] += n[k]
        out = table.drop_columns(["grp"])
        out = out.append_column("bin_id", pa.array([(grp << 32) + b for b in bins], pa.int64()))
        out = out.append_column("bin_size", pa.array([size[b] for b in bins], pa.int32())).append_column("bin_offset", pa.array(offset, pa.int32()))
        yield from out.combine_chunks().to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for a, b in zip(edges, edges[1:]):
                if held and held[0].column("grp")[0].as_py() != grp[a]:
                    yield from whole(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from whole(pa.Table.from_batches(held))

    return map_arrow(dealt, each, schema)


def pack_documents(docs: DataFrame, file: str = VOCABULARY, sizes: tuple[int, ...] = SIZES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of the documents' whole texts in bins; see ``packed_sequences``."""
    return packed_sequences(written(token_lengths(docs, file), "token-lengths"), sizes, group_tokens)
