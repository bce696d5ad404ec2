"""Plan shapes against brute force, on data with hot keys and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.operators.linkage import top_similar
from textweave.plans import ordering
from textweave.plans.concordance import concordant_pairs
from textweave.plans.knn import nearest_neighbours
from textweave.plans import skew
from textweave.plans.skew import salted_join
from textweave.plans.timejoin import nearest_times, window_join


def test_exact_quantiles_with_hot_value_and_groups(spark):
    rng = random.Random(1)
    rows = [("hot", 5.0)] * 300 + [("hot", rng.uniform(0, 9)) for _ in range(401)] + [("one", 2.5)] + [("two", float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): r.q for r in ordering.exact_quantiles(df, "v", [0.01, 0.25, 0.5, 0.99], ["g"]).collect()}
    for g in ("hot", "one", "two"):
        values = [v for k, v in rows if k == g]
        for p in (0.01, 0.25, 0.5, 0.99):
            assert got[g, p] == pytest.approx(np.quantile(values, p))
    flat = {r.p: r.q for r in ordering.exact_quantiles(df, "v", [0.5]).collect()}
    assert flat[0.5] == pytest.approx(np.quantile([v for _, v in rows], 0.5))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert ordering.exact_quantiles(df, "v", [0.5]).count() == 0


def test_running_totals_and_average_ranks(spark):
    values = [random.Random(2).randint(0, 40) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ranks = {r.value: r.avg_rank for r in ordering.average_ranks(df, "v").collect()}
    for v in set(values):
        places = [i + 1 for i, x in enumerate(sorted(values)) if x == v]
        assert ranks[v] == pytest.approx(sum(places) / len(places))


def test_dense_index_is_complete_and_ordered(spark):
    df = spark.range(0, 1000).withColumn("k", F.xxhash64("id"))
    rows = ordering.with_dense_index(df, ["k"], "i").orderBy("i").collect()
    assert [r.i for r in rows] == list(range(1000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 11}") for i in range(600)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "k string, x int")
    want = sorted(map(tuple, left.join(right, "k", how).select("k", "id", "x").collect()), key=str)
    got = salted_join(left, right, ["k"], ["id"], how, rows_per_salt=20).select("k", "id", "x").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_grid_join_equals_plain_join(spark):
    """A key hot on both sides: every pair once, and no cell with more than the given rows of a side (but for the hash's spread)."""
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 11}") for i in range(900)] + [(-1, None)], "a int, k string")
    right = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(700)] + [(-1, None)], "b int, k string")
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    joined = skew.grid_join(left, right, ["k"], ["a"], ["b"], rows_per_salt=50)
    assert sorted(map(tuple, joined.select("k", "a", "b").collect())) == want
    hot = skew.hot_keys(left, ["k"], 50).collect()
    assert [(r.k, r._salts) for r in hot if r.k == "hot"] == [("hot", 12)]
    lines = left.filter("k = 'hot'").groupBy(F.pmod(F.xxhash64("a"), F.lit(12))).count().agg(F.max("count")).first()[0]
    assert lines < 100


def test_window_join_hot_on_both_sides(spark):
    left = [(i, 5000) for i in range(150)] + [(i, i * 40) for i in range(150, 200)]
    right = [(i, 5010) for i in range(200)] + [(i, i * 31) for i in range(200, 260)]
    df = window_join(spark.createDataFrame(left, "a int, _t bigint"), spark.createDataFrame(right, "b int, _t bigint"), 70, 30, "b", rows_per_salt=40)
    assert sorted((r.a, r.b, r._gap) for r in df.collect()) == sorted((a, b, u - t) for a, t in left for b, u in right if t - 70 <= u <= t + 30)


def test_nearest_times_ties_and_hot_instant(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5000) * 10, i) for i in range(300)] + [(20_000, 1000 + i) for i in range(150)]
    docs = [rng.randint(-100, 60_000) for _ in range(200)] + [20_000, 20_000]
    got = {r._t: (r._gap, r.row_id) for r in nearest_times(spark.createDataFrame([(t,) for t in docs], "_t bigint"), spark.createDataFrame(rows, "_t bigint, row_id bigint")).collect()}
    for t in set(docs):
        assert got[t] == min((abs(x - t), i) for x, i in rows)


def test_nearest_times_without_rows(spark):
    docs = spark.createDataFrame([(5,)], "_t bigint")
    rows = spark.createDataFrame([], "_t bigint, row_id bigint")
    assert nearest_times(docs, rows).count() == 0


def test_window_join_negative_times_and_salts(spark):
    rng = random.Random(4)
    left = [(i, rng.randint(-3000, 3000)) for i in range(120)]
    right = [(i, rng.randint(-3000, 3000)) for i in range(200)]
    df = window_join(spark.createDataFrame(left, "a int, _t bigint"), spark.createDataFrame(right, "b int, _t bigint"), 70, 30, "b")
    got = sorted((r.a, r.b, r._gap) for r in df.collect())
    assert got == sorted((a, b, u - t) for a, t in left for b, u in right if t - 70 <= u <= t + 30)


def test_nearest_neighbours_with_copies_and_small_blocks(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(150, 3)), np.tile([[1.0, 1.0, 1.0]], (80, 1))])
    queries = np.vstack([rng.normal(size=(40, 3)), [[1.0, 1.0, 1.0]]])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "pid bigint, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "qid bigint, vec array<double>")
    got: dict[int, list] = {}
    for r in nearest_neighbours(q, p, 5, "qid", "pid", pivots=9, block=16).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pid)
    for i, v in enumerate(queries):
        d = np.sqrt(((points - v) ** 2).sum(1))
        assert got[i] == list(np.lexsort((np.arange(len(points)), d))[:5])


def test_fewer_points_than_k_and_zero_vectors(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "pid bigint, vec array<double>")
    q = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 0.0])], "qid bigint, vec array<double>")
    got = {(r.qid, r.pid): r.score for r in top_similar(q, p, 5, "qid", "pid").collect()}
    assert got[7, 2] == pytest.approx(0.5**0.5)
    assert got[7, 1] == pytest.approx(0) and got[8, 1] == pytest.approx(0) and got[8, 2] == pytest.approx(0)


def test_concordant_pairs(spark):
    rng = random.Random(6)
    pairs = {(rng.randint(0, 12), rng.randint(0, 9)): rng.randint(1, 4) for _ in range(70)}
    df = spark.createDataFrame([(float(x), float(y), n) for (x, y), n in pairs.items()], "x double, y double, n bigint")
    want = sum(n * m for (x, y), n in pairs.items() for (u, v), m in pairs.items() if u < x and v < y)
    assert concordant_pairs(df).first().concordant == want
