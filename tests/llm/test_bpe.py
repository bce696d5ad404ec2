"""Byte-pair encoding against the tokenizers library, texts with awkward characters, and the query."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents
from textweave.llm import bpe
from textweave.llm.queries import op13
from textweave.llm.tokens import public_file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_file("word_bpe_49k.json"))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


ODD = [
    None, "", " \t\n", "a <|endoftext|>x<|startoftext|> <|endoftext|", "ΑΣ Σίσυφος ΣΑΣ, ß. İstanbul", "a\u0085b\x1cc d e", "don't 've'll re's 12³٣",
    "é Å ﬁ Ɤ՘ \U0001fae9", "日本語 😀😀.", "ab" * 40_000 + " " + "x" * 30_000, " ".join(["word"] * 3000) + "\n" + "é" * 500,
]


def test_coder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_CHARS", 1000)
    coder = bpe.Bpe()
    letters = "abcDE '\"’sSétΣσςİÅé \t\n\u0085\x1c\x1f 123٣日😀ﬁ.,-'ll'veꟋ՘"
    rng = random.Random(3)
    mixed = ["".join(rng.choices(letters, k=rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|"]) for _ in range(3000)]
    for text in ODD + mixed:
        ids, decoded = expected(library, text)
        assert coder.encode(text) == ids and coder.decode(ids) == decoded
    assert coder.decode(None) == ""


def test_every_letter_of_the_first_planes(library):
    coder = bpe.Bpe()
    texts = [f"a{chr(c)}B{chr(c)} {chr(c)}x" for c in range(0, 0x20000, 3) if not 0xD800 <= c < 0xE000]
    coded = library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, coded) if coder.encode(t) != np.array(e.ids, "<u4").tobytes()] == []


def test_words_are_forgotten_between_texts(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY", 2)
    coder = bpe.Bpe()
    for text in ("one two three four", "four three", "five one"):
        assert coder.encode(text) == expected(library, text)[0]


def test_stale_entries_keep_the_merge_order(library):
    """Words whose queue holds pairs that an earlier merge has taken apart."""
    coder = bpe.Bpe()
    for word in ("aaaaaaa", "ananananas", "thethethe", "mississippi", "ininginging"):
        assert coder.encode(word) == expected(library, word)[0]


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(public_file("word_bpe_49k.json"), encoding="utf-8"))
    spec["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(path))


def test_columns_stay_and_rows_repeat(spark, library):
    docs = corpus(spark).withColumn("ids", F.lit("own")).withColumn("decoded", F.lit(None).cast("string"))
    rows = bpe.encode(docs).collect()
    assert len(rows) == docs.count() and rows[0].ids == "own" and list(rows[0].asDict()) == docs.columns
    texts = {(r.doc_id, r.n_chars): r.text for r in docs.collect()}
    for r in rows:
        assert bytes(r.text) == expected(library, texts[r.doc_id, r.n_chars])[0]
    assert bpe.encode(docs.limit(0)).count() == 0 and bpe.decode(bpe.encode(docs.limit(0)), "text").count() == 0


def test_query_equals_the_library(spark, small, library):
    got = {r.doc_id: r for r in op13(spark, small).collect()}
    docs = documents(spark, small)
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids, decoded = expected(library, text)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
