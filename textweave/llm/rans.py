"""Token files with a static range asymmetric numeral system.

One frequency table is counted over all tokens of the corpus and shared by all blocks. A block holds the tokens of whole
documents, dealt to LANES coders in turn; each lane keeps a 64-bit state in [2**31, 2**63) and sheds 32-bit words, so a
step of all lanes is a handful of array operations. Every CHECK_STEPS steps a checkpoint stores the lanes' states and the
place in the word stream, from which decoding can begin. Each block carries the CRC-32 of its tokens.

Layout of a block, little-endian: b"RANS", version u16, table bits u16, lanes u32, tokens u64, crc u32, checkpoints u32,
words u64; per checkpoint: step u64, word offset u64, lanes x u64 states; then the words, u32 each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import map_arrow, shuffle_width, written
from textweave.llm.tokens import VOCABULARY, encoder

BITS = 20
LANES = 1024
CHECK_STEPS = 512
ROWS = 500  # documents encoded at once
BLOCK_TOKENS = 1 << 19
END_ID = 2
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sHHIQIIQ")


# -- the coder -----------------------------------------------------------------------------------------------------


def quantized(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 wherever the count is positive."""
    total, size = int(counts.sum()), 1 << bits
    freq = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if not len(used):
        return freq
    if len(used) > size:
        raise ValueError(f"{len(used)} symbols do not fit a table of {size}")
    freq[used] = np.maximum(1, counts[used].astype(np.float64) / total * size).astype(np.int64)
    # what rounding left over or took too much is settled at the largest frequencies, where it costs least
    order = used[np.argsort(-freq[used], kind="stable")]
    rest = size - int(freq.sum())
    if rest >= 0:
        freq[order[0]] += rest
    for s in order if rest < 0 else ():
        cut = min(-rest, int(freq[s]) - 1, max(1, int(freq[s]) // 8))
        freq[s] -= cut
        rest += cut
        if not rest:
            break
    while rest < 0:
        s = int(np.argmax(freq))
        cut = min(-rest, int(freq[s]) // 2)
        freq[s] -= cut
        rest += cut
    return freq


class Table:
    """Shared frequency table: frequency and first slot of each symbol, and the symbol of each slot."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.first = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, check_steps: int = CHECK_STEPS) -> bytes:
    """The block of an array of ids (uint32); empty arrays give a block without words."""
    n, bits = len(ids), np.uint64(table.bits)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []  # in the order of coding, the reverse of decoding
    marks: list[tuple[int, int, bytes]] = []
    written_words = 0
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes : (step + 1) * lanes]
        live = state[: len(part)]
        f, c = table.freq[part], table.first[part]
        full = live >= f << np.uint64(63 - table.bits)
        if full.any():
            words.append((live[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written_words += len(words[-1])
            live = np.where(full, live >> np.uint64(32), live)
        q = live // f
        state[: len(part)] = (q << bits) + (live - q * f) + c
        if step % check_steps == 0:
            marks.append((step, written_words, state.astype("<u8").tobytes()))
    stream = b"".join(w.tobytes() for w in reversed(words))
    head = HEAD.pack(b"RANS", 1, table.bits, lanes, n, zlib.crc32(ids.astype("<u4").tobytes()), len(marks), written_words)
    return head + b"".join(struct.pack("<QQ", step, written_words - w) + s for step, w, s in reversed(marks)) + stream


def decode_block(block: bytes, table: Table, checkpoint: int = 0, most_steps: int | None = None) -> np.ndarray:
    """Ids from a checkpoint on, ``most_steps`` steps of all lanes or to the end; a whole block is held against its CRC."""
    magic, version, bits, lanes, n, crc, marks, n_words = HEAD.unpack_from(block)
    if magic != b"RANS" or version != 1 or bits != table.bits:
        raise ValueError("not a block of this table")
    if not n:
        return np.empty(0, np.uint32)
    size = 16 + 8 * lanes
    at = HEAD.size + checkpoint * size
    step, offset = struct.unpack_from("<QQ", block, at)
    state = np.frombuffer(block, "<u8", lanes, at + 16).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, HEAD.size + marks * size).astype(np.uint64)
    last = -(-n // lanes)
    end = last if most_steps is None else min(last, step + most_steps)
    out = np.empty(min(n, end * lanes) - step * lanes, np.uint32)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    for k in range(step, end):
        live = state[: min(lanes, n - k * lanes)]
        slot = live & mask
        symbol = table.slots[slot.astype(np.int64)]
        out[(k - step) * lanes : (k - step) * lanes + len(live)] = symbol
        live = table.freq[symbol] * (live >> shift) + slot - table.first[symbol]
        low = live < LOW
        many = int(low.sum())
        if many:
            live[low] = (live[low] << np.uint64(32)) | words[offset : offset + many]
            offset += many
        state[: len(live)] = live
    if step == 0 and end == last and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not hold")
    return out


def packed(ids: np.ndarray) -> bytes:
    """Ids for the way between two steps: a byte for their width, then zstd over 16 bits each where that is enough."""
    width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(ids.astype(f"<u{width}").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype("<u4")


# -- on Spark ------------------------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, file: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(shard, nth, doc_id, n_tokens, ids) written in ascending doc_id order; shard is the range a document falls into.

    ``ids`` are packed. Null ids come first; repeated ids are ordered by text.
    """
    # the range partitioner samples its input, so ranges are cut before texts go through the tokenizer
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                ids, at = encoder(file).encode(part.column("text").to_pylist())
                ids = ids.astype("<u4", copy=False)
                end = np.array([end_id], "<u4")
                parts = [packed(np.r_[ids[a:b], end]) for a, b in zip(at, at[1:])]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(nth, nth + n)), part.column("doc_id"), pa.array(np.diff(at) + 1), pa.array(parts, pa.binary())],
                    ["shard", "nth", "doc_id", "n_tokens", "ids"],
                )
                nth += n

    kind = dict(docs.dtypes)["doc_id"]
    return written(map_arrow(ordered, encode, f"shard int, nth bigint, doc_id {kind}, n_tokens bigint, ids binary"), "token-ids")


def token_table(tokens: DataFrame, bits: int = BITS) -> Table:
    """The frequency table over all tokens; its size is the vocabulary's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                part = np.bincount(unpacked(data.as_py()), minlength=len(seen))
                part[: len(seen)] += seen
                seen = part
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["id", "n"])

    rows = map_arrow(tokens.select("ids"), count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return Table(quantized(counts, bits), bits)


def write_token_file(
    docs: DataFrame, folder: str, file: str = VOCABULARY, end_id: int = END_ID, bits: int = BITS, block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encode whole texts, each followed by ``end_id``, and write them below ``folder``.

    ``folder``/blocks holds one row per block: shard, block, start (ids of all documents before its first), doc_ids,
    sizes, data; shards and blocks ascend with doc_id. ``folder``/table holds (id, freq) of the shared table. Null texts
    have the end id alone. An empty table gives empty files. Rows that repeat are written as often as they occur.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, file, end_id)
    table = token_table(tokens, bits)
    held = spark.sparkContext.broadcast((table.freq.astype(np.int64), bits))  # as large as the vocabulary
    # one total per shard, of which there are as many as shuffle partitions
    totals = {r.shard: r.n for r in tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, at = {}, 0
    for shard in sorted(totals):
        bases[shard] = at
        at += totals[shard]
    kind = dict(docs.dtypes)["doc_id"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(*held.value)
        shard, block, start, size = None, 0, 0, 0
        ids: list[np.ndarray] = []
        who: list = []

        def out() -> pa.RecordBatch:
            row = {
                "shard": [shard], "block": [block], "start": [start], "doc_ids": [who], "sizes": [[len(x) for x in ids]],
                "data": [encode_block(np.concatenate(ids), shared)],
            }
            kinds = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(key)), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
            return pa.RecordBatch.from_pydict(row, kinds)

        for batch in batches:
            key = batch.column("doc_id").type
            for s, d, data in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if ids and (s != shard or size >= block_tokens):
                    yield out()
                    start, block, ids, who, size = start + size, block + 1, [], [], 0
                if s != shard:
                    shard, block, start = s, 0, bases[s]
                ids.append(unpacked(data.as_py()))
                who.append(d)
                size += len(ids[-1])
        if ids:
            yield out()

    dealt = tokens.select("shard", "nth", "doc_id", "ids").repartitionByRange(shuffle_width(spark), "shard").sortWithinPartitions("shard", "nth")
    map_arrow(dealt, blocks, f"shard int, block int, start bigint, doc_ids array<{kind}>, sizes array<bigint>, data binary").write.parquet(f"{folder}/blocks")
    rows = [(int(i), int(f)) for i, f in enumerate(table.freq) if f]
    spark.createDataFrame(rows, "id bigint, freq bigint").coalesce(1).write.parquet(f"{folder}/table")


def read_token_file(spark, folder: str, bits: int = BITS) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are little-endian uint32."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    rows = spark.read.parquet(f"{folder}/table").toPandas()  # as large as the vocabulary
    freq = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    freq[rows["id"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast((freq, bits))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*held.value)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode_block(batch.column("data")[k].as_py(), table).astype("<u4")
                sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False)
                upto = np.cumsum(sizes)
                start = batch.column("start")[k].as_py() + upto - sizes
                parts = [ids[a:b].tobytes() for a, b in zip((upto - sizes).tolist(), upto.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[k].values, pa.array(start), pa.array(sizes), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
                )

    kind = dict(blocks.dtypes)["doc_ids"][6:-1]
    return map_arrow(blocks.select("start", "doc_ids", "sizes", "data"), decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
