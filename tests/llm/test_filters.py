"""Quality rules, line dedup and substring dedup."""

import collections
import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from tests.llm.helpers import PASSAGE, WORD, corpus
from textweave.llm import linededup, quality, substring

WS = " \t\n\x0b\f\r"


def repeat_words(w):
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return len(covered)


def test_quality_measures(spark):
    docs = corpus(spark, [(20, "a b c d e x a b c d e y\nline\nline\n\n\n# $", "en", "a", 1), (21, "la la la la la la la", "fr", "a", 1)])
    docs = docs.withColumn("quality", F.lit("own")).withColumn("common", F.lit(1))
    got = quality.quality_rules(docs, min_documents=3).select("doc_id", "text", "common", "quality.*").collect()
    assert len(got) == docs.count()
    for r in got:
        t = r.text or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(w) < 10 or 100 * want[4] > 20 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
    kept = quality.keep_good(docs, min_documents=3)
    assert kept.columns == docs.columns and kept.filter("quality = 'own'").count() == sum(r.kept for r in got)


def test_quality_rejects_what_diverges(spark):
    prose = [(100 + i, f"The house number {i} of the town is on the hill and it was built for a man that had to live in it. " * 4 + f"End {i * i}.", "en", "s", 1) for i in range(40)]
    prose = [(i, " ".join(dict.fromkeys(t.split())) + " of the hill and to the sea in a day, it is for me that the sun was on it, as all of us know by now, at the end of time", *r) for i, t, *r in prose]
    junk = [(900, " | ".join(f"tok{i}en" for i in range(80)), "en", "s", 1), (901, "$$$ &&& ### *** %%% <<< >>> " * 3 + " ".join(f"#{i}$" for i in range(90)), "en", "s", 1)]
    got = {r.doc_id: r.quality for r in quality.quality_rules(spark.createDataFrame(prose + junk, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert all(got[i].kept for i, *_ in prose) and not got[900].kept and not got[901].kept


def test_quality_empty(spark):
    assert quality.quality_rules(corpus(spark).limit(0)).collect() == []


def kept_lines(rows, min_length=20, min_documents=3):
    by = collections.defaultdict(set)
    key = lambda line: line.strip(WS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    below = lambda i: -1 if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            by[key(line)].add(below(i))
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_length or len(by[key(x)]) < min_documents or max(by[key(x)]) == below(i)]
        yield i, len(lines), len(lines) - len(stay), "\n".join(stay)


def test_line_dedup(spark):
    shared = "This line is found in every one of the documents"
    more = [(30 + i, f"own line number {i} of this text\n  {shared if i % 2 else shared.upper()}\t\n" + (shared + "\n") * (i % 3), None, "x", 1) for i in range(60)]
    more += [(200, "\n".join(f"{k} a line that only three documents have" for k in range(150)), "en", "y", 1)] * 2
    more += [(201 + k, "\n".join(f"{k} a line that only three documents have" for k in range(150)), "en", "y", 1) for k in range(2)]
    docs = corpus(spark, more).withColumn("lines", F.lit(5)).withColumn("keep", F.lit(0))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for salt in (2_000, 4):
        got = sorted((str(r.doc_id), r.lines.n_lines, r.lines.n_dropped, r.text) for r in linededup.dedup_lines(docs, rows_per_salt=salt).collect())
        assert got == sorted((str(a), *b) for a, *b in kept_lines(rows))
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.filter("lines = 5 AND keep = 0").count() == len(rows)
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_line_dedup_sorts_once(spark):
    plan = linededup.keep_bitmaps(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 1 and "rangepartitioning(h1" in plan and "Python" not in plan and "Arrow" not in plan


def brute_spans(rows, min_words):
    first, spans = {}, []
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        run = []
        for a, b, n, h in [*substring.units(t, "sentence"), (0, 0, 0, None)]:
            if h is not None and h in first:
                run.append((a, b, n))
                continue
            first.setdefault(h, i) if h else None
            if sum(x[2] for x in run) >= min_words:
                spans.append((i, run[0][0], run[-1][1]))
            run = []
    return spans


def test_substring_dedup(spark):
    docs = corpus(spark, [(40, "Something else before it. " + PASSAGE + " And after it.", "en", "z", 1), (41, "Short one. Short one. Short one.", "en", "z", 1)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spans = substring.repeated_spans(docs)
    got = sorted((r.doc_id, r.start, r.stop) for r in spans.collect())
    assert got == sorted(brute_spans(rows, 15)) and {g[0] for g in got} >= {4, 5, 40}
    left = {r.doc_id: r.text for r in substring.remove_spans(docs, spans).collect()}
    assert left[3] == PASSAGE and left[4] == "" and left[40] == "Something else before it. And after it." and left[0] is None
    assert substring.remove_spans(docs, spans).count() == len(rows)
    assert substring.repeated_spans(docs.limit(0)).collect() == []


def test_line_digests_match_contract(spark, small):
    from textweave.llm.queries import op9

    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in kept_lines(source)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op9(spark, small).collect()} == want


def test_common_words_are_counted_without_the_long_ones(spark):
    """Exact counts, and a text that is searched for every common word holds no longer word."""
    common = ["the", "a", "né", "𝄞𝄞𝄞𝄞", "x"]
    texts = ["the then the\tthe\n\nother a a", "  né néné 𝄞𝄞𝄞𝄞 𝄞𝄞𝄞𝄞𝄞 ", "the", "", None, "lengthy\x0bthe the the  the", " \t ", "a" * 5 + " a a a " + "b" * 9]
    docs = spark.createDataFrame([(t, common) for t in texts], "text string, common array<string>")
    counted = quality.word_counts(docs, "text", "common", 4)
    split = [[w for w in re.split(r"[ \x09-\x0D]+", t or "") if w] for t in texts]
    assert [r["_counts"] for r in counted.collect()] == [[ws.count(c) for c in common[:4]] for ws in split]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "{5,}" in plan


def test_character_classes_are_a_partition(spark):
    texts = ["Plain text, with  two blanks\tand\nlines 12½ É é é #$ (x)", "", None, "   𝄞 ǅ ß", "ABC def\x0b\x0c\r", "ünü bér"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r, t in zip(quality.char_classes(docs, "text").collect(), [t or "" for t in texts]):
        kind = [unicodedata.category(c) for c in t]
        assert r["_all"] == len(t) == sum(r[f"_{c}"] for c in quality.CLASSES)
        assert r["_white"] == sum(c in " \t\n\x0b\x0c\r" for c in t)
        assert r["_upper"] == kind.count("Lu") and r["_number"] == sum(k[0] == "N" for k in kind)
        assert r["_letter"] == sum(k[0] in "LM" and k != "Lu" for k in kind)
        assert r["_mark"] == sum(c in ".,;:!?'\"()-" for c in t) and r["_n_symbols"] == sum(c in "#*$%&|<>" for c in t)
