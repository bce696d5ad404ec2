"""Byte-pair encoding of whole texts and its reverse, with the vocabulary and merges of a public tokenizer file.

A text is cut at the file's special tokens, normalised, and cut into pre-tokens. Each pre-token starts as a doubly linked
list of single-byte symbols; a priority queue holds (rank, place) of every mergeable neighbour pair. The lowest entry is
merged if the pair at its place still has that rank; else the entry is stale and skipped. Decoding looks each id up and
concatenates the vocabulary strings with the blank that files without a decoder put between tokens.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textweave.llm.common import map_arrow, pieces
from textweave.llm.tokens import VOCABULARY, public_file

MEMORY = 300_000  # chunks without white space whose ids a worker remembers; about 80 MB
TEXT_CHARS = 4 << 20  # characters of text worked on at once
IDS_AT_ONCE = 1 << 20  # ids decoded at once

# Characters that Python splits at and the tokenizer does not count as white space.
NOT_WHITE = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    others = iter(range(256, 512))
    return [letters[b] if b in letters else chr(next(others)) for b in range(256)]


def lowered(text: str) -> str:
    """Lower case letter by letter: a capital sigma never becomes a final one."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class NewLetters(Exception):
    """A chunk has a character that this Python's Unicode tables do not know."""


class Bpe(dict):
    """Encoder and decoder of one tokenizer file; as a dict it remembers the id bytes of chunks it has met."""

    def __init__(self, file: str = VOCABULARY):
        super().__init__()
        self.file, self.library = public_file(file), None
        with open(self.file, encoding="utf-8") as source:
            spec = json.load(source)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        steps = cutter.get("pretokenizers", [])
        shape = [(s["type"], s.get("behavior"), s.get("invert")) for s in steps]
        if model["type"] != "BPE" or model.get("dropout") or spec["decoder"] or shape != [("Split", "Removed", True), ("ByteLevel", None, None)]:
            raise ValueError(f"{file}: only byte-level BPE with one kept pattern and no decoder is encoded here")
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError(f"{file}: its normaliser is not NFC, white space, lower case")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        # (left << 32 | right) -> rank << 32 | merged id
        self.ranks = {vocab[a] << 32 | vocab[b]: r << 32 | vocab[a + b] for r, (a, b) in enumerate(model["merges"])}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(word)
        symbol = [self.inner[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        queue = []
        for i in range(n - 1):
            found = ranks.get(symbol[i] << 32 | symbol[i + 1])
            if found is not None:
                queue.append((found, i))
        heapq.heapify(queue)
        while queue:
            found, i = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j >= n or ranks.get(symbol[i] << 32 | symbol[j]) != found:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = found & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                fresh = ranks.get(symbol[i] << 32 | symbol[k])
                if fresh is not None:
                    heapq.heappush(queue, (fresh, i))
            h = before[i]
            if h >= 0:
                fresh = ranks.get(symbol[h] << 32 | symbol[i])
                if fresh is not None:
                    heapq.heappush(queue, (fresh, h))
        return [s for s in symbol if s >= 0]

    def __missing__(self, chunk: str) -> bytes:
        if not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk):
            raise NewLetters
        ids = [i for word in self.pattern.findall(chunk) for i in self.merge(word.encode())]
        self[chunk] = packed = np.array(ids, "<u4").tobytes()
        return packed

    def _plain(self, text: str) -> bytes:
        low = lowered(unicodedata.normalize("NFC", text))
        chunks = WHITE.split(low) if NOT_WHITE.search(low) else low.split()
        if len(self) > MEMORY:
            self.clear()
        try:
            return b"".join([self[c] for c in chunks])
        except NewLetters:
            return self._cut_by_library(text)

    def _cut_by_library(self, text: str) -> bytes:
        """For texts with letters younger than this Python's tables: the library normalises and cuts, merging stays here."""
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.file)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        byte = {c: b for b, c in enumerate(byte_letters())}
        return np.array([i for word, _ in cut for i in self.merge(bytes(byte[c] for c in word))], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; none for null."""
        out = []
        for part in pieces(text or "", TEXT_CHARS):
            at = 0
            for mark in self.marks.finditer(part) if self.marks else ():
                out += [self._plain(part[at : mark.start()]), np.array([self.special[mark.group()]], "<u4").tobytes()]
                at = mark.end()
            out.append(self._plain(part[at:]))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Vocabulary strings of the ids with a blank between."""
        numbers = np.frombuffer(ids or b"", "<u4")
        parts = (numbers[a : a + IDS_AT_ONCE].tolist() for a in range(0, len(numbers), IDS_AT_ONCE))
        return " ".join(" ".join([self.tokens[i] for i in part]) for part in parts)


_coders: dict[str, Bpe] = {}


def coder(file: str = VOCABULARY) -> Bpe:
    """The worker's coder for a file; lives as long as the worker."""
    if file not in _coders:
        _coders[file] = Bpe(file)
    return _coders[file]


def _column(batch: pa.RecordBatch, column: str, weight: int, work, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """``batch`` with ``column`` replaced by ``work`` of its values, some megabytes at a time."""
    at, spot = 0, batch.schema.get_field_index(column)
    values = batch.column(column)
    while at < batch.num_rows:
        out, size, first = [], 0, at
        while at < batch.num_rows and size < TEXT_CHARS * weight:
            value = values[at].as_py()
            size += len(value or "")
            out.append(work(value))
            at += 1
        arrays = [pa.array(out, kind) if i == spot else c.slice(first, at - first) for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def _mapped(df: DataFrame, column: str, weight: int, method: str, file: str, kind: pa.DataType, sql: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = getattr(coder(file), method)
        for batch in batches:
            yield from _column(batch, column, weight, work, kind)

    schema = ", ".join(f"`{c}` {sql if c == column else t}" for c, t in df.dtypes)
    return map_arrow(df, run, schema)


def encode(df: DataFrame, column: str = "text", file: str = VOCABULARY) -> DataFrame:
    """``df`` with the text ``column`` replaced by its ids: binary, little-endian unsigned 32-bit integers.

    Null and empty texts have no ids (an empty value). Rows stay where they are: nothing is shuffled, repeated rows are
    encoded each, other columns of any name are kept, an empty table stays empty. A text must fit in memory; a text longer
    than some megabytes is worked on in parts cut at white space. Special tokens of the file are found in the texts.
    """
    return _mapped(df, column, 1, "encode", file, pa.binary(), "binary")


def decode(df: DataFrame, column: str = "ids", file: str = VOCABULARY) -> DataFrame:
    """``df`` with the binary id ``column`` replaced by the text the ids stand for; special tokens are kept.

    Null and empty values give the empty string; an id that the file does not have is an error. Rows stay where they are.
    """
    return _mapped(df, column, 4, "decode", file, pa.string(), "string")
