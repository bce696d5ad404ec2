"""Look-ups inside records, and text operators that stay there."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textweave.operators import features, sentiment, words
from textweave.plans import lookup
from textweave.plans.lineage import cut_lineage
from textweave.registry.frames import documents, lexicon


@pytest.mark.parametrize("most", [10, 0])
def test_lookup(spark, most):
    rows = [("a", ["x", "y", "x", None, "z"]), ("b", []), ("c", None), ("d", ["q"]), ("a", ["x"] * 50)]
    df = spark.createDataFrame(rows, "id string, t array<string>")
    entries = spark.createDataFrame([("x", 1, "one"), ("y", 2, None), ("y", 3, "three"), (None, 9, "none"), ("z", None, "last")], "k string, n int, w string")
    got = lookup.with_lookup(df, "t", entries, "k", ["n", "w"], most)
    assert got.columns == ["id", "t", "n", "w"]
    table = {"x": (1, "one"), "y": (2, None), "z": (None, "last")}
    want = sorted((i, t, [table.get(x, (None, None))[0] for x in t or []], [table.get(x, (None, None))[1] for x in t or []]) for i, t in rows if t)
    assert sorted((r.id, r.t, r.n, r.w) for r in got.collect() if r.t) == want
    assert all(r.n == [] and r.w == [] for r in got.collect() if not r.t)
    assert lookup.with_lookup(df, "t", entries.limit(0), "k", ["n"], most).filter("id = 'd'").first().n == [None]
    assert lookup.with_lookup(df.limit(0), "t", entries, "k", ["n"], most).count() == 0


@pytest.mark.parametrize("most", [lookup.ENTRIES, 0])
def test_tokens_by_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "ENTRIES", most)
    docs = spark.createDataFrame([("1", "Cats see dogs. A cat saw it! Cats"), ("2", ""), ("3", None), ("4", "Dogs")], "id string, text string")
    lex = spark.createDataFrame([("cats", "cat", "NOUN"), ("cat", "cat", "NOUN"), ("dogs", "dog", "NOUN"), ("saw", "see", "VERB"), ("see", "see", "VERB")], "form string, lemma string, pos string")
    table = {(r.doc_id, r.sent, r.pos): (r.form, r.lemma, r.tag) for r in words.token_table(docs, lex, ["it"]).collect()}
    assert table[("1", 0, 0)] == ("cats", "cat", "NOUN") and table[("1", 1, 0)] == ("a", "a", "X") and len(table) == 8
    text, by_sentence = words.coded_documents(docs, lex), words.coded_sentences(docs, lex)
    assert {r.doc_id: r.lemmas for r in words.lemma_lists(text).collect()} == {"1": ["cat", "see", "dog", "a", "cat", "see", "it", "cat"], "4": ["dog"]}
    facts = {r.doc_id: r[1:] for r in words.token_statistics(text).collect()}
    assert facts == {"1": (8, 3, 5, 4, 2), "4": (1, 1, 1, 1, 0)}
    for coded in (text, by_sentence):
        assert [(r.lemma, r.n) for r in words.common_lemmas(coded, 2).collect()] == [("cat", 3), ("dog", 2)]
        assert [(r.lemma, r.n) for r in words.common_lemmas(coded, 2, words.NOUN, by="forms").collect()] == [("cat", 2), ("dog", 1)]
    assert [r.sent for r in words.sentences_with_lemma(by_sentence, "see").orderBy("sent").collect()] == [0, 1]
    assert [tuple(r) for r in words.attributes(by_sentence, "see").collect()] == [("cat", 2), ("dog", 1)]
    assert [tuple(r) for r in words.dimensions(by_sentence, "dog").collect()] == [("see", 1)]
    assert [(r.sentence, r.word_rank) for r in words.summary(by_sentence, 1).collect()] == [("Cats see dogs.", 1), ("A cat saw it!", 1), ("Cats", 1)]
    assert Counter(r.noun for r in words.sentences_with_nouns(by_sentence).collect()) == {"cat": 3, "dog": 2}
    assert words.coding_dictionary(by_sentence).count() == 0  # the only verb describes the nouns


@pytest.mark.parametrize("many", [words.MANY, 0])
def test_counts_meet_the_lexicon_once(spark, monkeypatch, many):
    """The same as from coded text: forms are counted, or sentences picked, before the lexicon comes in."""
    monkeypatch.setattr(words, "MANY", many)
    docs = spark.createDataFrame([("1", "Cats see a dog. The cat saw dogs! Odd."), ("2", "A cat sees. That dog saw that"), ("3", None), ("4", "")], "id string, text string")
    entries = [("cat", "cat", "NOUN"), ("cats", "cat", "NOUN"), ("dog", "dog", "NOUN"), ("dogs", "dog", "NOUN"), ("dogs", "hound", "VERB"), ("see", None, "VERB"),
               ("sees", "see", "VERB"), ("saw", "see", "VERB"), ("saw", "see", None), ("the", "the", None), (None, "that", "NOUN"), ("odd", "odd", "ADJ"), ("a", "see", "VERB")]
    lex = spark.createDataFrame(entries, "form string, lemma string, pos string")
    by_sentence, plain = words.coded_sentences(docs, lex), words.sentence_forms(docs)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for tags in (None, words.NOUN, words.VERB):
        for by in ("frequency", "forms"):
            assert rows(words.common_lemmas(plain, 3, tags, by, lex)) == rows(words.common_lemmas(by_sentence, 3, tags, by))
    for lemma in ("see", "that", "cat", "hound", "a", "missing"):
        assert rows(words.sentences_with_lemma(plain, lemma, lex)) == rows(words.sentences_with_lemma(by_sentence, lemma))
        assert rows(words.attributes(plain, lemma, 3, lex)) == rows(words.attributes(by_sentence, lemma))
        assert rows(words.dimensions(plain, lemma, 3, lex)) == rows(words.dimensions(by_sentence, lemma))
    assert rows(words.coding_dictionary(plain, 2, 3, lex)) == rows(words.coding_dictionary(by_sentence, 2, 3))
    for n in (1, 3, 9):
        assert rows(words.sentences_with_nouns(plain, n, lex)) == rows(words.sentences_with_nouns(by_sentence, n))
        assert rows(words.summary(plain, n, lex)) == rows(words.summary(by_sentence, n)) != []
    listed = words.token_table(docs, lex).groupBy("tag", "pos").agg(F.count(F.lit(1)).alias("n"), F.max("lemma").alias("last_lemma"))
    assert rows(words.tokens_by_place(docs, lex)) == rows(listed) != []
    plan = words.common_lemmas(plain, 3, words.NOUN, lexicon=lex)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_sentences_are_not_kept(spark, monkeypatch):
    """Sentences beside their words are many times the input: they are told again, not checkpointed or written."""
    labels, real = [], words.written
    monkeypatch.setattr(words, "cut_lineage", lambda df: [labels.append(df.columns), cut_lineage(df)][1])
    monkeypatch.setattr(words, "written", lambda df, label: [labels.append(df.columns), real(df, label)][1])
    docs = spark.createDataFrame([("1", "Cats see a dog. The cat saw dogs!")], "id string, text string")
    lex = spark.createDataFrame([("cat", "cat", "NOUN"), ("cats", "cat", "NOUN")], "form string, lemma string, pos string")
    plain = words.sentence_forms(docs)
    assert {r.noun for r in words.sentences_with_nouns(plain, 2, lex).collect()} == {"cat"} and words.summary(plain, 1, lex).count() == 2
    assert labels and not any("sentence" in columns for columns in labels)


def test_wide_rows_are_not_sorted(spark):
    """Rows that meet their rare words again are neither sorted nor wider than their words."""
    df = spark.createDataFrame([(i, ["the", f"w{i}"]) for i in range(50)], "id bigint, t array<string>")
    entries = spark.createDataFrame([("the", 1), *[(f"w{i}", i) for i in range(50)]], "k string, n int")
    got = lookup.with_lookup(df, "t", entries, "k", ["n"], 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and {r.id: r.n for r in got.collect()} == {i: [1, i] for i in range(50)}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Scan parquet")


def test_tokens_stay_in_their_records(spark, small):
    """No exchange and one scan of the documents once the lexicon is at hand."""
    docs, lex = documents(spark, small), lexicon(spark, small).cache()
    flat = exchanges(docs)
    for df in (words.lemma_lists(words.coded_documents(docs, lex)), words.token_table(docs, lex), sentiment.sentiment_scores(docs, lex), features.token_sequences(docs, 50)):
        assert exchanges(df) == flat
    assert exchanges(words.attributes(words.coded_sentences(docs, lex), "that"))[1] == flat[1]
    lex.unpersist()


def test_sequences(spark):
    docs = spark.createDataFrame([("1", "b a b c"), ("2", ""), ("3", None), ("4", "a " * 9)], "id string, text string")
    got = {r.doc_id: r.sequence for r in features.token_sequences(docs, 2, 5).collect()}
    assert got == {"1": [2, 1, 2, 0, 0], "2": [0] * 5, "3": [0] * 5, "4": [1] * 5}
    assert docs.filter(F.col("text").isNull()).count() == 1


def test_only_rare_elements_leave_their_row(spark, monkeypatch):
    """With more entries than a task holds, elements of the held words are not joined."""
    rows = [(i, ["the", "of", f"w{i}", None, "the", "odd" if i % 7 else "also"]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, t array<string>").repartition(5)
    entries = spark.createDataFrame([("the", 1), ("of", None), ("also", 2), *[(f"w{i}", 10 + i) for i in range(0, 300, 2)]], "k string, n int")
    seen = []
    joined = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, *a, **k: seen.append(self) or joined(self, other, *a, **k))
    got = {r.id: r.n for r in lookup.with_lookup(df, "t", entries, "k", ["n"], 4).collect()}
    table = dict(map(tuple, entries.collect()))
    assert got == {i: [table.get(x) for x in t] for i, t in rows}
    cells = [x for x in seen if "_pos" in x.columns]
    assert len(cells) == 1 and cells[0].count() == 300
