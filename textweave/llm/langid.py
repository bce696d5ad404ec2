"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts per language and hash bucket are summed over all training texts on Spark; the matrix of log probabilities, of
languages times buckets, is broadcast; texts are scored in batches of their n-grams only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import map_arrow

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.05
CELLS = 1 << 22  # n-grams times languages scored at once
UNKNOWN = "und"
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a blank."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number, letters in each text) of all n-grams, in the order of the texts. Runs of blanks count once."""
    sizes = np.array([len(t) + 1 for t in texts])
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    low = letter_table()[code]
    owner = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(owner, weights=low != 32, minlength=len(texts)).astype(np.int64)
    keep = np.r_[True, (low[1:] != 32) | (low[:-1] != 32)] if len(low) else np.zeros(0, bool)
    low, owner = low[keep], owner[keep]
    buckets, owners = [], []
    for n in ORDERS:
        if len(low) < n:
            continue
        m = len(low) - n + 1
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ low[k : k + m]) * MIX[k]
            h ^= h >> np.uint32(15)
        # an n-gram lies in one text and has a letter
        inside = owner[:m] == owner[n - 1 :]
        inside &= np.logical_or.reduce([low[k : k + m] != 32 for k in range(n)])
        buckets.append((h[inside] & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int64))
        owners.append(owner[:m][inside])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64), letters
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return bucket[order], own[order], letters


def portions(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of consecutive texts with about ``most`` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


class Model:
    """Languages, their log priors, and log probabilities by bucket and language."""

    def __init__(self, langs: list[str], counts: np.ndarray, documents: np.ndarray):
        self.langs = langs
        if langs:
            self.prior = np.log(documents / documents.sum())
            self.table = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1])).T.copy()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language and its posterior; UNKNOWN and 0 for null texts, texts without a letter, or without languages."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        most = max(1 << 12, CELLS // len(self.langs) // len(ORDERS))
        for _, part in portions([t or "" for t in texts], most):
            bucket, own, letters = grams(part)
            total = np.tile(self.prior, (len(part), 1))
            for at in range(0, len(bucket), most):
                o = own[at : at + most]
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                total[o[first]] += np.add.reduceat(self.table[bucket[at : at + most]], first, axis=0)
            best = total.argmax(axis=1)
            posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            langs += [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters)]
            scores += [float(p) if n else 0.0 for p, n in zip(posterior, letters)]
        return langs, scores


def train(labelled: DataFrame) -> Model:
    """The model of all rows (text, lang) with both; counts of each language and bucket come back to the driver."""
    source = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BUCKET_BITS
        seen: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, part in portions(batch.column("text").to_pylist(), CELLS // 8):
                bucket, own, _ = grams(part)
                ends = np.searchsorted(own, np.arange(len(part) + 1))
                for k in range(len(part)):
                    lang = langs[at + k]
                    if lang not in seen:
                        seen[lang], number[lang] = np.zeros(size, np.int64), 0
                    number[lang] += 1
                    seen[lang] += np.bincount(bucket[ends[k] : ends[k + 1]], minlength=size)
        for lang, counts in seen.items():
            used = np.flatnonzero(counts)
            # bucket -1 holds the number of documents
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.r_[-1, used]), pa.array(np.r_[number[lang], counts[used]])], ["lang", "bucket", "n"]
            )

    rows = map_arrow(source, count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    place = {lang: k for k, lang in enumerate(langs)}
    matrix = np.zeros((len(langs), (1 << BUCKET_BITS) + 1))
    matrix[rows["lang"].map(place).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64) + 1] = rows["n"].to_numpy(np.float64)
    return Model(langs, matrix[:, 1:], matrix[:, 0])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); columns of these names are replaced, nothing but ``text`` is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    source = docs.select(*[f"`{c}`" for c in own])
    at = own.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    return map_arrow(source, score, ", ".join([*fields, "lang_pred string", "score double"]))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
