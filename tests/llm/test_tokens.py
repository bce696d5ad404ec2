"""Encoder, token files, packing."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents
from textweave.llm import packing, rans, tokens
from textweave.llm.tokens import Encoder, public_file
from textweave.session import new_folder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_file("word_bpe_49k.json"))


ODD = ["a ", "", "<|endoftext|>x  <|startoftext|>", "İstanbul Σίσυφος ΣΑΣ, ß. don't it's 3.14 a., é., ñ, x́, ́, --, ,.", None, "a b\u0085c d'", "A\x0bB\x0cC\r\nD", "日本語 テスト。 😀, 😀.", "'s 't 're,", "é. Å, ǅ. ǅ,"]


def test_encoder_equals_the_tokenizer(tokenizer):
    coder = Encoder()
    for _ in range(2):  # words new, then remembered
        ids, at = coder.encode(ODD)
        for k, t in enumerate(ODD):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    assert coder.encode([])[0].tolist() == []


def test_words_of_one_polynomial_hash_are_told_apart(tokenizer):
    turn = ["a", "b"]
    for _ in range(11):
        turn = [turn[0] + turn[1], turn[1] + turn[0]]
    for size in (64, 1024, 2048):
        coder = Encoder()
        for word in (turn[0][:size], turn[1][:size]):
            assert coder.encode([word])[0].tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_hashes_that_meet_are_noticed(tokenizer, monkeypatch):
    """With a first hash that knows only lengths, the second one sends texts to the tokenizer whole."""
    monkeypatch.setattr(tokens, "HASH", lambda data, start, end: (end - start).astype(np.uint64))
    coder = Encoder()
    for texts in (["one two six", None, "three"], ["ten", "one"], ODD):
        ids, at = coder.encode(texts)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_block_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 40_000).astype(np.uint32)
    table = rans.Table(rans.quantized(np.bincount(ids, minlength=3)))
    block = rans.encode_block(ids, table, check_steps=64)
    assert (rans.decode_block(block, table) == ids).all()
    if n > 200_000:
        assert (rans.decode_block(block, table, checkpoint=2, most_steps=5) == ids[128 * 1024 : 133 * 1024]).all()
        with pytest.raises(ValueError):
            rans.decode_block(block[:-4] + b"\x00\x01\x02\x03", table)


def test_quantized_sums():
    rng = np.random.default_rng(0)
    for counts in (np.array([1]), np.array([0, 5]), rng.zipf(1.2, 50_000), np.r_[10**12, np.ones(1000, int)]):
        freq = rans.quantized(np.minimum(counts, 10**12))
        assert freq.sum() == 1 << rans.BITS and (freq[np.asarray(counts) > 0] >= 1).all()


def test_token_files(spark, tokenizer):
    docs = corpus(spark).withColumn("shard", F.lit("own"))
    folder = new_folder(spark, "test-tokens")
    rans.write_token_file(docs, folder, block_tokens=50_000)
    got = sorted(rans.read_token_file(spark, folder).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        at += len(ids)
    empty = new_folder(spark, "test-tokens")
    rans.write_token_file(docs.limit(0), empty)
    assert rans.read_token_file(spark, empty).collect() == []


def test_token_query(spark, small, tokenizer):
    from textweave.llm.queries import op8

    got = {r.doc_id: r for r in op8(spark, small).collect()}
    at = 0
    for i, t in sorted(documents(spark, small)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def brute_best_fit(lengths, sizes):
    """The rule with a plain search of all open bins."""
    rooms, used, out, left = [], [], {}, sum(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [b for b, r in enumerate(rooms) if r >= lengths[k]]
        if fits:
            least = min(rooms[b] for b in fits)
            b = [b for b in fits if rooms[b] == least][-1]
        else:
            b = len(rooms)
            rooms.append(min((s for s in sizes if s >= lengths[k]), key=lambda s: (packing.size_cost(s) / max(1, min(s, left)), s)))
            used.append(0)
        rooms[b] -= lengths[k]
        used[b] += lengths[k]
        left -= lengths[k]
        out[k] = b
    return len(rooms), [min(s for s in sizes if s >= u) for u in used]


def test_pack_is_best_fit():
    rng = np.random.default_rng(4)
    for sizes in ((64,), (16, 32, 64)):
        lengths = rng.integers(1, 65, 200).tolist()
        bins, size = packing.pack(lengths, sizes)
        fill = np.bincount(bins, weights=lengths, minlength=len(size))
        assert (fill <= size).all() and all(min(s for s in sizes if s >= f) == z for f, z in zip(fill, size))
        n, want = brute_best_fit(lengths, sizes)
        assert len(size) == n and sum(size) == sum(want)
    assert packing.pack([], (8,)) == ([], [])


def test_larger_bins_are_opened_and_cut_down():
    rng = np.random.default_rng(6)
    lengths = [600] * 1001 + np.minimum(rng.lognormal(6, 1.2, 2000), 4096).astype(int).clip(1).tolist()
    cost = lambda size: sum(packing.size_cost(s) for s in size)
    bins, size = packing.pack_ahead(lengths, packing.SIZES)
    fill = np.bincount(bins, weights=lengths, minlength=len(size))
    assert (fill <= size).all() and all(min(s for s in packing.SIZES if s >= f) == z for f, z in zip(fill, size))
    assert cost(size) < 0.97 * cost(packing.pack(lengths, packing.SIZES)[1])
    # copies alone: several to a bin, and the last bin is cut down to what is left
    bins, size = packing.pack_ahead([600] * 7, packing.SIZES)
    assert sorted(np.bincount(bins).tolist()) == [1, 3, 3] and sorted(size) == [1024, 2048, 2048]
    assert packing.pack_ahead([], (8,)) == ([], [])


def test_groups_are_packed_ahead(spark):
    rows = spark.range(3001).select(F.col("id").alias("doc_id"), F.col("id").alias("text_hash"), F.lit(600).cast("bigint").alias("n_tokens"))
    got = packing.packed_sequences(rows).groupBy("bin_id", "bin_size").agg(F.sum("n_tokens").alias("n")).collect()
    assert sum(r.n for r in got) == 600 * 3001 and sum(r.bin_size for r in got) < 1.2 * 600 * 3001 and len({r.bin_size for r in got}) > 1


def test_repeats_of_a_row_are_spread_over_groups(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("text_hash"), F.lit(600).cast("bigint").alias("n_tokens"))
    got = packing.packed_sequences(rows, group_tokens=400_000).select((F.col("bin_id") / 2**32).cast("int").alias("grp")).groupBy("grp").count().collect()
    assert len(got) == 31 and max(r["count"] for r in got) < 900


def test_packing_keeps_every_token(spark):
    docs = corpus(spark).withColumn("piece", F.lit("own"))
    lengths = {}
    for r in packing.token_lengths(docs).collect():
        lengths.setdefault((r.doc_id, r.text_hash), []).append(r.n_tokens)
    got = packing.pack_documents(docs, group_tokens=40_000).collect()
    total = {}
    for r in got:
        total[r.doc_id, r.text_hash] = total.get((r.doc_id, r.text_hash), 0) + r.n_tokens
    assert total == {k: sum(v) for k, v in lengths.items()}
    places = sorted((r.bin_id, r.bin_offset, r.n_tokens, r.bin_size) for r in got)
    for a, b in zip(places, places[1:]):
        assert a[0] != b[0] or a[1] + a[2] == b[1]
    assert all(o + n <= s and s in packing.SIZES for _, o, n, s in places) and len({p[0] >> 32 for p in places}) > 1
    assert packing.pack_documents(docs.limit(0)).collect() == []
