"""SimHash near-dedup, components, decontamination."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import PASSAGE, corpus, documents, words
from textweave.llm import decontam, simhash
from textweave.llm.components import connected_components


def brute_print(text, n=4):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= most
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b))


def test_links_are_complete(spark):
    rng = np.random.default_rng(1)
    flip = lambda x, k: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    base = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    prints = [*base, *[flip(c, k) for c in base[:30] for k in range(1, 9)], *[flip(base[0], 3) for _ in range(250)]]
    prints = np.unique(np.array(prints, np.uint64))
    frame = spark.createDataFrame(pd.DataFrame({"fp": prints.view(np.int64)}))
    for most, bucket in ((4, 1024), (4, 8), (6, 32)):
        roots = {r.node: r.root for r in connected_components(simhash.links(frame, most, bucket)).collect()}
        assert same_partition(brute_components(prints, most), [roots.get(int(f), int(f)) for f in prints.view(np.int64)])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 900 + i) for i in range(60)] + [(5, 5), (None, 3), (7, 6)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {roots[i] for i in range(61)} == {0} and {roots[900 + i] for i in range(60)} == {900} == {roots[1000]}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_duplicates(spark):
    docs = corpus(spark).withColumn("fp", F.lit(1)).withColumn("root", F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    prints = np.array([brute_print(r.text) for r in rows], np.uint64)
    by = {(r.doc_id, p): None for r, p in zip(rows, prints.tolist())}
    assert {(r.doc_id, int(np.int64(r.fp).view(np.uint64))) for r in got} == set(by) and len(got) == len(rows)
    labels = brute_components(prints, 4)
    low = {k: min((r.doc_id for r, x in zip(rows, labels) if x == k and r.doc_id is not None), default=None) for k in set(labels)}
    assert {(r.doc_id, r.component_id) for r in got} == {(r.doc_id, low[k]) for r, k in zip(rows, labels)}
    kept = simhash.keep_one(docs, words=4, most=4)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted([str(v) if v is not None else "None" for v in low.values()])  # one row for each component, copies of a row included
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []


def test_prints_of_the_tables(spark, small):
    from textweave.llm.queries import op2

    got = {r.doc_id: r.fingerprint for r in op2(spark, small).collect()}
    assert all(got[i] == f"{brute_print(t):016x}" for i, t in documents(spark, small, 60))


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: the longest unmarked common run first."""
    fa, fb, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        fa[i : i + n] = [False] * n
        fb[j : j + n] = [False] * n
        total += n


def test_tiles_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, 60).astype(np.uint64), rng.integers(0, 4, 30).astype(np.uint64)
        tiles = decontam.tile(a, b, 3)
        assert sum(n for *_, n in tiles) == brute_tiles(a.tolist(), b.tolist(), 3)
        for i, j, n in tiles:
            assert (a[i : i + n] == b[j : j + n]).all()


def test_contaminations(spark):
    w = PASSAGE.split()
    turned = " ".join([*w[30:], "between", *w[:30]])  # reordered
    docs = corpus(spark, [(50, "Before. " + turned + " After.", "en", "a", 1), (51, "nothing of it at all in here, not one run", "en", "a", 1), (52, " ".join(w[:9]), "en", "a", 1)])
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "two words"), (5, PASSAGE)], "item_id bigint, text string")
    for block in (decontam.BLOCK_BYTES, 100):
        found = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs, items, block_bytes=block).collect()}
        assert found == {(d, i) for d in (3, 4, 5, 50) for i in (1, 5)}
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["0", "1", "2", "None", "6", "7", "51", "52"])
    assert decontam.contaminations(docs.limit(0), items).collect() == [] and decontam.contaminations(docs, items.limit(0)).collect() == []
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()


def test_short_items_are_found_whole(spark):
    docs = corpus(spark, [(50, "so What is\nit again, what is it", "en", "a", 1), (51, "what is", "en", "a", 1), (52, "it what is", "en", "a", 1), (53, "a b c d e f g h", "en", "a", 1)])
    items = spark.createDataFrame([(1, "What is it"), (2, "again,"), (3, "a b c d e f g"), (4, "a b c d e x g"), (5, "h it"), (6, PASSAGE), (7, " ")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminations(docs, items).collect()}
    assert set(got) == {(50, 1), (50, 2), (53, 3), *((d, 6) for d in (3, 4, 5))}  # neither parts nor runs over two documents
    assert [tuple(t) for t in got[50, 1].tiles] == [(1, 0, 3)] and got[50, 1].coverage == 1
    assert got[53, 3].item_tokens == 7 and {50, 53} <= {r.doc_id for r in decontam.clean(docs, items).collect()}  # reported, but no reason to go
    common = spark.createDataFrame([(1, "of")], "item_id bigint, text string")
    assert decontam.clean(docs, common).count() == docs.count()


def test_words_of_one_polynomial_hash_are_told_apart():
    turn = ["a", "b"]
    for _ in range(11):
        turn = [turn[0] + turn[1], turn[1] + turn[0]]
    hashes, _ = decontam.token_hashes(np.frombuffer(" ".join(turn).encode(), np.uint8))
    assert hashes[0] != hashes[1]
    huge = [t.encode() * 3 for t in turn] + [b"x" * 4096, b"x" * 4097, b"x" * 8, b"x" * 9, b"\x00", b"\x00\x00"]
    assert len(set(decontam.token_hashes(np.frombuffer(b" ".join(huge), np.uint8))[0].tolist())) == len(huge)
    same, _ = decontam.token_hashes(np.frombuffer(f"{turn[0].upper()} x {turn[0]}".encode(), np.uint8))
    assert same[0] == same[2] == hashes[0]
