"""Results and plans that only differ from the simple ones where tables are large."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textweave.operators import linkage, stats, words


def test_spearman_of_more_records_than_a_bigint_can_cube(spark):
    n = 2_200_000
    df = spark.range(n).select((F.col("id") % 7).alias("a"), (F.col("id") % 7 + F.col("id") % 2).alias("b"), (F.col("id") % 3).alias("c"))
    gaps = df.withColumn("c", F.when(F.col("a") != 9, F.col("c"))).unionByName(spark.sql("SELECT 1L AS a, 1L AS b, CAST(NULL AS BIGINT) AS c"))
    ids = np.arange(n)
    x, y = ids % 7, ids % 7 + ids % 2

    def ranks(v):
        values, at, count = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[at]

    expected = np.corrcoef(ranks(x), ranks(y))[0, 1]
    for frame in (df, gaps):
        found = {(r["variable_1"], r["variable_2"]): r["correlation"] for r in stats.correlation_pairs(frame, ["a", "b", "c"], "spearman").collect()}
        assert len(found) == 3
        assert abs(found["a", "b"] - expected) < 1e-5


def test_outcomes_through_hubs_meet_no_values(spark):
    """Mean, first and commonest through keywords against the links one by one, for numbers and for mixed values."""
    rng = random.Random(3)
    values = {i: str(rng.randint(1, 400)) for i in range(300)} | {7: "many", 8: "many", 9: "1e2"}
    docs = spark.createDataFrame([(str(i), {"m": v}) for i, v in values.items()], "id string, metadata map<string,string>")
    words = [(str(i), rng.choice("abcdefgh")) for i in range(300) for _ in range(2)] + [("7", "rare"), ("8", "rare")]
    keywords = spark.createDataFrame(words, "doc_id string, keyword string")
    texts = [(r, " ".join(rng.sample("abcdefgh", 3))) for r in range(40)] + [(40, "rare"), (41, "rare a"), (42, "none")]
    rows = spark.createDataFrame(texts, "row_id long, text string")
    hubs = linkage.link_by_keyword(keywords, rows, "text")
    one_by_one = hubs.pairs()
    for how in ("mean", "first", "majority"):
        told = {r.row_id: r.value for r in linkage.text_outcome(docs, hubs, "m", how).collect()}
        assert told == {r.row_id: r.value for r in linkage.text_outcome(docs, one_by_one, "m", how).collect()}
        assert set(told) == set(range(42)) and told[40] == "many"
    numbers = docs.filter("metadata['m'] <> 'many'")
    plan = linkage.text_outcome(numbers, hubs, "m", "mean")
    # the rows meet one sum per hub: no record per row, hub and value is made
    assert "_n" not in plan.columns and "value" in plan.columns
    met = hubs.row_side.join(hubs.doc_side, "hub").count()
    assert met > 20 * hubs.row_side.count()
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_categories_and_baskets_count_what_can_matter(spark):
    rng = random.Random(9)
    lists = [(str(i), [rng.choice("aaaabbbccd") + rng.choice(["", "", "x", "yz"]) for _ in range(rng.randint(0, 40))]) for i in range(60)]
    lists += [("0", ["a", "a", "a"]), ("empty", [])]

    def grams(ws):
        return [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]

    def best(counted, n):
        return sorted(((c, v) for c, v in counted.items()), key=lambda e: (-e[1], e[0]))[:n]

    df = spark.createDataFrame(lists, "doc_id string, lemmas array<string>")
    for rows in (lists, [*lists, ("blank", ["a b", "a b"] * 40)], [("one", ["a", "b", "a"])]):
        every = Counter(g for _, ws in rows for g in grams(ws))
        got = words.categories(spark.createDataFrame(rows, df.schema), 6).collect()
        assert [(r.category, r.n) for r in got] == best(every, 6)
        assert all(abs(r.weight - r.n / sum(every.values())) < 1e-12 for r in got)
    per_record = [(d, best(Counter(grams(ws)), 99)) for d, ws in lists]
    baskets = words.category_baskets(df, 5)
    told = sorted((r.doc_id, r["rank"], r.n) for r in baskets.collect())
    want = [(d, i + 1, -m) for d in {d for d, _ in lists} for i, (m, _) in enumerate(sorted((-v, c) for e, cs in per_record if e == d for c, v in cs)[:5])]
    assert told == sorted(want)
    plan = baskets._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan  # a record passes on its five best


def test_outcome_by_time_window_lists_no_links(spark):
    """Against the links one by one, with repeated ids, shared instants and values that are no numbers."""
    rng = random.Random(11)
    at = lambda: f"2024-01-01 {rng.randint(0, 5):02d}:{rng.choice([0, 7, 30]):02d}:00"
    docs = [(str(rng.randint(0, 70)), at(), {"m": str(rng.randint(1, 9))}) for _ in range(90)] + [("71", "2024-01-01 03:30:01", {"m": "many"}), ("72", None, {"m": "1"})]
    documents = spark.createDataFrame(docs, "id string, ts string, metadata map<string,string>").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = spark.createDataFrame([(rng.randint(0, 60), at()) for _ in range(80)], "row_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for how in ("mean", "majority"):
        one_by_one = linkage.text_outcome(documents, linkage.link_by_time_window(documents, rows), "m", how)
        told = linkage.outcome_by_time_window(documents, rows, "m", how)
        assert sorted(told.collect()) == sorted(one_by_one.collect()) and told.count() > 20
    once = documents.dropDuplicates(["id"])
    first = linkage.outcome_by_time_window(once, rows, "m", "first")
    assert sorted(first.collect()) == sorted(linkage.text_outcome(once, linkage.link_by_time_window(once, rows), "m", "first").collect())
