"""Similar texts: no pair is missed, and no gram leaves its text."""

import random

import pytest
from pyspark.sql import functions as F

from textweave.operators import network
from textweave.plans import edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def sample():
    rng = random.Random(5)

    def change(x, most):
        x = list(x)
        for _ in range(rng.randint(0, most)):
            x[rng.randrange(len(x))] = rng.choice(["", "a", "bé", "ß"])
        return "".join(x)

    words = ["la ", "thor ", "né", "ting", "and ", "ß", "en", "𝄞"]
    base = ["".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 5, 6, 8, 9, 12, 20, 21, 30, 40) for _ in range(3)]
    base += ["la la " * 80, "la la " * 76 + "la", "thor la " * 60, "".join(rng.choice(words) for _ in range(140))]
    return sorted({t for b in base for t in (b, change(b, 2), change(b, max(1, len(b) // 11)), change(b, len(b) // 7 + 1))} | {"", "a", "ab"})


@pytest.mark.parametrize("least, block_chars", [(0.9, edits.BLOCK_CHARS), (0.9, 300), (0.6, 2000)])
def test_every_similar_pair_is_found(spark, monkeypatch, least, block_chars):
    monkeypatch.setattr(edits, "BLOCK_CHARS", block_chars)
    texts = [t for t in sample() if least == 0.9 or len(t) < 120]
    want = {}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            most = int((1 - least) * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and (d := distance(a, b)) <= most:
                want[a, b] = 1 - d / max(len(a), len(b))
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:9], None]], "sentence string")
    dealt = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: dealt.append(self) or repartition(self, *a))
    found = network.similarity_edges(df, least).collect()
    got = {(r.source, r.target): r.weight for r in found}
    assert len(found) == len(got) and got == pytest.approx(want) and len(want) > 40
    if block_chars == edits.BLOCK_CHARS == 8_000_000:
        assert sum(x.count() for x in dealt) <= 2 * len(texts)  # texts are dealt, not their grams


def test_lengths_are_dealt_to_all_blocks_they_may_meet():
    sizes = [(n, n % 7 + 1) for n in range(1, 300)]
    listed, blocks = edits.lanes(sizes, 0.9, 500)
    at = {n: (home, parts, past) for n, home, parts, past in listed}
    assert blocks > 50 and at[9][0] is None
    for n in range(10, 300):
        home, parts, _ = at[n]
        for short in range(n - int(0.1 * n + 1e-9), n + 1):
            assert set(range(home, home + parts)) <= set(at[short][2])


def test_none_and_empty(spark):
    for rows in ([], [(None,)], [("",), ("one text that is long enough",)]):
        assert network.similarity_edges(spark.createDataFrame(rows, "sentence string"), 0.9).count() == 0
    same = spark.createDataFrame([("one text that is long enough",), ("one text that is long enougH",)], "sentence string")
    assert network.similarity_edges(same, 1.0).count() == 0
    assert network.similarity_edges(same.withColumn("x", F.col("sentence")), 0.9, "x").count() == 1
