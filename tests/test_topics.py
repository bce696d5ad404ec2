"""Topic fitting against plain numpy, coherence against windows listed one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.operators import coherence, lda, topics


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 7.9, 8.0, 100.0, 1e7])
    assert lda.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    h = 1e-5
    slope = [(math.lgamma(v + h * v) - math.lgamma(v - h * v)) / (2 * h * v) for v in x]
    assert lda.digamma(x) == pytest.approx(slope, rel=1e-5, abs=1e-5)


def corpus(spark, n=60):
    rng = np.random.default_rng(3)
    words = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    rows = []
    for d in range(n):
        mix = rng.dirichlet([0.2] * 3)
        rows.append((f"d{d}", [words[t][min(11, rng.geometric(0.25) - 1)] for t in rng.choice(3, rng.integers(5, 40), p=mix)]))
    rows += [("empty", []), ("none", None)]
    return spark.createDataFrame(rows, "doc_id string, lemmas array<string>"), rows


def plain_pass(cells, weights, alpha):
    """One pass over (document, term, n) cells, document by document; (given per term, gamma per document)."""
    k = weights.shape[1]
    beta = np.exp(lda.digamma(weights) - lda.digamma(weights.sum(axis=0)))
    given, gammas = np.zeros_like(weights), {}
    for doc, terms in cells.items():
        t, n = np.array(list(terms)), np.array(list(terms.values()), float)
        gamma = np.full(k, alpha + n.sum() / k)
        for _ in range(lda.ITERATIONS):
            theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
            norm = beta[t] @ theta + 1e-100
            new = alpha + theta * (n / norm @ beta[t])
            change, gamma = np.abs(new - gamma).mean(), new
            if change < lda.STILL:
                break
        theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
        norm = beta[t] @ theta + 1e-100
        given[t] += (n / norm)[:, None] * theta * beta[t]
        gammas[doc] = gamma
    return given, gammas


@pytest.mark.parametrize("at_once", [200_000, 50])
def test_passes_equal_plain_numpy(spark, monkeypatch, at_once):
    monkeypatch.setattr(lda, "CELLS", at_once)
    df, _ = corpus(spark)
    start = lda.fit(df, topics=3, passes=0)
    weights = np.array([r.weights for r in start.weights.orderBy("term").collect()])
    cells = {}
    for r in start.cells.collect():
        cells.setdefault(r.doc_id, {})[r.term] = r.n
    for _ in range(4):
        given, _ = plain_pass(cells, weights, start.alpha)
        weights = start.eta + given
    fitted = lda.fit(df, topics=3, passes=4)
    got = np.array([r.weights for r in fitted.weights.orderBy("term").collect()])
    assert got == pytest.approx(weights, rel=1e-3, abs=1e-3) and fitted.totals == pytest.approx(weights.sum(axis=0), rel=1e-4)
    gammas = plain_pass(cells, weights, start.alpha)[1]
    rows = fitted.document_weights().collect()
    assert {r.doc_id for r in rows} == set(gammas)
    assert all(r.gamma == pytest.approx(gammas[r.doc_id], rel=1e-2, abs=2e-2) for r in rows)


def test_a_common_term_is_told_once_by_a_core(spark, monkeypatch):
    """However many splits the documents have, what a pass gives back grows with the cores; documents of any pass stay where they are."""
    assert lda.HELD >= 1_000_000
    told, real = [], lda.written
    monkeypatch.setattr(lda, "written", lambda df, label: [told.append((label, df)), real(df, label)][1])
    df, _ = corpus(spark)
    fitted = lda.fit(df.repartition(40), topics=3, passes=1)
    assert fitted.rare is None
    (given,) = [d for label, d in told if label == "topic-weights"]
    plan = given._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in plan and "Join" not in plan


def test_tasks_tell_blocks_of_terms(spark, monkeypatch):
    """What a pass gives back is a row per task and block of terms, not one per term; words are counted outside the JVM."""
    told, real = [], lda.written
    monkeypatch.setattr(lda, "written", lambda df, label: [told.append((label, df)), real(df, label)][1])
    df, _ = corpus(spark)
    lda.fit(df, topics=3, passes=1)
    plans = {label: d._jdf.queryExecution().executedPlan().toString() for label, d in told}
    assert "FlatMapGroupsInArrow" in plans["topic-weights"] and "HashAggregate" not in plans["topic-weights"]
    assert "MapInArrow" in plans["counted-words"] and "sort_array" not in plans["counted-words"]


def test_words_are_counted_as_before(spark):
    rows = [("a", ["x", None, "y", "x"]), ("a", ["z"]), ("b", None), ("c", []), (None, ["x", "x"]), ("d", [None])]
    got = lda.fit(spark.createDataFrame(rows, "doc_id string, lemmas array<string>"), topics=2, passes=1)
    words = {r.term: r.word for r in got.vocabulary.collect()}
    assert {(r.doc_id, words[r.term], r.n) for r in got.cells.collect()} == {("a", "x", 2), ("a", "y", 1), ("a", "z", 1), (None, "x", 2)}


@pytest.mark.parametrize("sizes", [[3, 900, 1, 1, 40, 41, 42], [1] * 300, [7000, 2]])
def test_shares_equal_one_document_at_a_time(sizes):
    rng = np.random.default_rng(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    beta, n = rng.gamma(0.3, 1, (len(owner), 4)), rng.integers(1, 4, len(owner)).astype(float)
    gamma, theta, norm = lda.fitted_shares(beta, n, owner, len(sizes), 0.25)
    for d in range(len(sizes)):
        own = owner == d
        got = lda.fitted_shares(beta[own], n[own], np.zeros(own.sum(), int), 1, 0.25)
        assert gamma[d] == pytest.approx(got[0][0], rel=2e-2, abs=1e-1)
        assert norm[own] == pytest.approx(beta[own] @ theta[d], rel=1e-9)


@pytest.mark.parametrize("sizes", [[80, 90, 100], [1, 2, 1, 3] * 20])
def test_sums_by_term(sizes):
    rng = np.random.default_rng(1)
    term = np.concatenate([np.sort(rng.choice(120, s, replace=False)) for s in sizes])
    share, want, got = rng.random((len(term), 3)), np.zeros((120, 3)), np.zeros((120, 3))
    np.add.at(want, term, share)
    lda._add(got, term, share, np.repeat(np.arange(len(sizes)), sizes))
    assert got == pytest.approx(want)
    back = np.zeros((120, 3))
    for batch in lda._told(*lda._summed(term, share), 50):
        (block,), (t,), (g,) = (c.to_pylist() for c in batch.columns)
        t = np.frombuffer(t, np.int64)
        assert (t // 50 == block).all()
        back[t] += np.frombuffer(g).reshape(-1, 3)
    assert back == pytest.approx(want)


def test_topics_are_found(spark):
    df, rows = corpus(spark, 120)
    model = topics.fit_topics(df, topics=3, passes=25)
    first = {}
    for r in topics.topic_words(model, 5).collect():
        first.setdefault(r.topic, []).append(r.word[0])
    assert sorted("".join(sorted(set(v))) for v in first.values()) == ["a", "b", "c"]
    weights = {r.doc_id: r.weights for r in model.scored.collect()}
    assert set(weights) == {d for d, _ in rows} and all(sum(w) == pytest.approx(1) for w in weights.values())
    assert weights["empty"] == pytest.approx([1 / 3] * 3)
    worse = topics.fit_topics(df, topics=3, passes=1)
    assert worse.log_perplexity < model.log_perplexity < 0
    index = df.select("doc_id", F.row_number().over(topics.Window.orderBy("doc_id")).cast("bigint").alias("position"))
    told = topics.token_topics(model, index, 1, 3).collect()
    ids = [r.doc_id for r in index.filter("position between 1 and 2").collect()]
    assert {(r.doc_id, r.word) for r in told} == {(d, w) for d, ws in rows if d in ids for w in ws or []}


def test_nothing_of_vocabulary_size_reaches_the_driver(spark, monkeypatch):
    """40,000 words; a collected row table would be as long."""
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    for name in ("collect", "toPandas"):
        real = getattr(Classic, name)
        monkeypatch.setattr(Classic, name, lambda self, real=real: [seen.append(len(out := real(self))), out][1])
    df = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.expr("transform(sequence(1, 100), i -> concat('w', id * 100 + i))").alias("lemmas"))
    model = topics.fit_topics(df, topics=2, passes=1)
    assert model.model.terms == 40_000 and max(seen, default=0) < 500
    assert topics.topic_words(model, 3).count() == 6


def test_empty_corpus(spark):
    df = spark.createDataFrame([("a", [])], "doc_id string, lemmas array<string>")
    model = topics.fit_topics(df, topics=2, passes=2)
    assert [r.weights for r in model.scored.collect()] == [[0.5, 0.5]] and topics.topic_words(model, 2).count() == 0
    assert model.log_perplexity == 0


def listed_windows(lists, window):
    for tokens in lists:
        for s in range(max(len(tokens) - window, 0) + 1 if tokens else 0):
            yield set(tokens[s : s + window])


@pytest.mark.parametrize("hits", [100_000, 20])
def test_coherence_equals_listed_windows(spark, monkeypatch, hits):
    monkeypatch.setattr(coherence, "HITS_AT_ONCE", hits)
    rng = np.random.default_rng(5)
    lists = [[f"w{i}" for i in rng.integers(0, 30, rng.integers(0, 90))] for _ in range(40)]
    listed = [("x", r, f"w{w}") for r, w in enumerate([3, 7, 11, 2, 40])] + [("y", r, f"w{w}") for r, w in enumerate([3, 1, 5])]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(lists)] + [("n", None)], "doc_id string, lemmas array<string>")
    words = spark.createDataFrame(listed, "topic string, rank int, word string")
    windows = list(listed_windows(lists, 10))
    p = lambda *ws: sum(all(w in s for w in ws) for s in windows) / len(windows)
    want_npmi, want_cv = {}, {}
    for topic in "xy":
        own = [w for t, _, w in listed if t == topic]

        def npmi(a, b):
            j = p(a, b) + 1e-12
            return 0 if not p(a) or not p(b) else math.log(j / (p(a) * p(b))) / -math.log(j)

        m = np.array([[npmi(a, b) for b in own] for a in own])
        want_npmi[topic] = np.mean([m[i, j] for i in range(len(own)) for j in range(i + 1, len(own))])
        v = m.sum(axis=0)
        want_cv[topic] = np.mean([r @ v / (np.linalg.norm(r) * np.linalg.norm(v)) if r.any() else 0 for r in m])
    assert {r.topic: r.npmi for r in topics.coherence(words, df, 10).collect()} == pytest.approx(want_npmi)
    assert {r.topic: r.c_v for r in topics.coherence_cv(words, df, 10).collect()} == pytest.approx(want_cv)


@pytest.mark.parametrize("held", [5, 1])
def test_rare_terms_meet_their_documents(spark, monkeypatch, held):
    """The same topics whether a task holds all weights or only those of the commonest terms; cells are not moved for the others."""
    df, _ = corpus(spark)
    both = df.unionByName(df.limit(7))  # some documents come in two records
    want = lda.fit(both, topics=3, passes=3)
    told = [(r.term, pytest.approx(r.weights, rel=1e-9)) for r in want.weights.orderBy("term").collect()]
    gammas = {r.doc_id: pytest.approx(r.gamma, rel=1e-9) for r in want.document_weights().collect()}
    counts = [r.n for r in want.vocabulary.orderBy("term").collect()]
    assert want.rare is None and counts == sorted(counts, reverse=True)
    monkeypatch.setattr(lda, "HELD", held)
    got = lda.fit(both, topics=3, passes=3)
    assert got.rare.count() == got.cells.filter(F.col("term") >= held).count() < got.cells.count()
    assert [(r.term, r.weights) for r in got.weights.orderBy("term").collect()] == told
    assert {r.doc_id: r.gamma for r in got.document_weights().collect()} == gammas
