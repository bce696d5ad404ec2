"""Spelling variants against all pairs, odd texts, and the query against a plain version."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LOWER, corpus, documents
from textweave.llm import spelling
from textweave.llm.queries import op12


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def near_pairs(words):
    """All near pairs, both ways, by the strings that a deletion leaves."""
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    return {(a, b) for group in holes.values() for a in group for b in group if one_edit(a, b)}


def expected(counts, ratio=2):
    near = defaultdict(list)
    for a, b in near_pairs(counts):
        near[a].append(b)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def plain_counts(docs, least=5, often=3, every=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("letters, share", [("ab", 20_000), ("abcé", 50), ("abcdefgh×", 4)])
def test_equals_all_pairs(spark, letters, share):
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(4, 9))): rng.randint(3, 40) for _ in range(500)}
    words |= {w + "s": n * rng.randint(1, 3) for w, n in list(words.items())[:100]}
    long = "ab" * 700
    words |= {long: 3, long + "x": 9, "c" + long: 4, long[:900] + "y" + long[901:]: 30, long[:900] + long[901:]: 8}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(spelling.variants(df, share=share)) == expected(words)


def test_short_and_missing_words(spark):
    df = spark.createDataFrame([("abc", 3), ("abcd", 9), (None, 4), ("", 5), ("abce", 2)], "word string, n bigint")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(df).collect()}
    assert got == {"abc": (None, "abc", 0), "abcd": (None, "abcd", 1), None: (None, None, 0), "": (None, "", 0), "abce": ("abcd", "abcd", 1)}
    assert spelling.variants(df.limit(0)).count() == 0


def test_counts_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 20)
    docs = corpus(spark, [(20 + i, "Straße STRASSE naïveté ÀÉÎ×÷ÿ wörter " * 3, "de", "a", 1) for i in range(40)]).withColumn("word", F.lit("own")).withColumn("n", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for every in (None, 97, 2):
        got = {r.word: r.n for r in spelling.word_counts(docs, typo_every=every).collect()}
        assert got == plain_counts(rows, every=every)
    assert spelling.word_counts(docs.limit(0)).count() == 0


def test_decomposition_is_kept_by_edits_elsewhere():
    rng = random.Random(1)
    frequent = {"".join(rng.choices("abc^$", k=k)): k for k in (2, 2, 2, 3, 3, 3) for _ in range(40)}
    for _ in range(2000):
        a = "".join(rng.choices("abc", k=rng.randint(4, 10)))
        i = rng.randrange(len(a) + 1)
        b = a[:i] + rng.choice("abc") + a[i + rng.randint(0, 1) :]
        ga, gb = spelling.decompose(f"^{a}$", frequent), spelling.decompose(f"^{b}$", frequent)
        lost = sum((Counter(ga) - Counter(gb)).values())
        assert lost <= spelling.affected(ga, len(a) + 2)
        p, q = spelling.rarest_apart(ga, frequent)
        shift = range(len(b) - len(a) + 1) if len(b) >= len(a) else ()
        assert not shift or any(x + s < len(gb) and gb[x + s] == ga[x] for x in (p, q) for s in shift)


def test_query_equals_a_plain_version(spark, small):
    assert found(op12(spark, small)) == expected(plain_counts(documents(spark, small)))


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    """Entries are many times a word's record, so the size of the words' table must not lead to a broadcast."""
    plans, real = [], spelling.written
    monkeypatch.setattr(spelling, "written", lambda df, label: [plans.append(df), real(df, label)][1])
    df = spark.createDataFrame([(f"w{i:05d}", 3 + i % 50) for i in range(300)], "word string, n bigint")
    out = spelling.variants(df)
    assert out.filter("n_near > 0").count() == 300
    told = [p._jdf.queryExecution().executedPlan().toString() for p in [*plans, out]]
    assert sum("Join" in p for p in told) >= 3 and not any("Broadcast" in p for p in told)
