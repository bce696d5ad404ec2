"""One-hot of any width, copies, and models through links."""

import pytest
from pyspark.sql import functions as F

from textweave.operators import features, linkage, ml


def test_many_levels_become_a_sparse_column(spark):
    df = spark.range(6000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 5000).alias("c"), F.when(F.col("id") % 2 == 0, "x").when(F.col("id") % 3 > 0, "y").alias("d"))
    out = features.one_hot(df, ["c", "d"])
    assert out.columns == ["row_id", "c_levels", "d_y"]
    rows = {r.row_id: r for r in out.collect()}
    levels = sorted({f"v{i % 5000}" for i in range(6000)})
    assert len(rows) == 6000
    for i in (0, 1, 3, 777, 4999, 5000, 5999):
        place = levels.index(f"v{i % 5000}") - 1
        assert rows[i].c_levels.size == 4999 and rows[i].c_levels.indices == ([place] if place >= 0 else [])
        assert rows[i].d_y == int(i % 2 == 1 and i % 3 > 0)
    both = features.one_hot_sparse(df.limit(50), ["d", "c"]).filter("row_id = 1").first().features
    assert both.size == 50 and both.indices[0] == 0 and len(both.indices) == 2 and both["values"] == [1.0, 1.0]


def test_more_levels_than_any_table_has_columns(spark):
    """200,000 levels and one that fills two thirds of the rows; only widths reach the driver."""
    df = spark.range(600_000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 400_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("c"))
    out = features.one_hot_sparse(df, ["c"])
    assert out.select("features.size").first()[0] == 200_000
    assert out.filter(F.size("features.indices") == 0).count() == 400_000 and out.select(F.explode("features.indices")).distinct().count() == 200_000


def test_levels_of_no_text(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "row_id int, c string")
    assert features.one_hot(df, ["c"]).columns == ["row_id"]
    got = features.one_hot_sparse(df, ["c"]).collect()
    assert [tuple(r.features) for r in got] == [(0, [], [])] * 2
    x, _ = features.prepare(spark.createDataFrame([(1, "a", 1), (2, "b", 0)], "row_id int, c string, y int"), "y", booleans=True)
    assert "c_b" in x.columns


def test_models_take_sparse_columns(spark, monkeypatch):
    monkeypatch.setattr(features, "COLUMNS", 3)
    rows = spark.range(400).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 8).alias("c"), (F.col("id") % 5).alias("n"), (F.col("id") % 8 >= 4).cast("int").alias("y"))
    x = features.one_hot(rows, ["c"])
    assert "c_levels" in x.columns
    assert ml.linear_svm(x, ["n", "c_levels"], "y").scores.first().accuracy == 1
    assert ml.random_forest(x, ["n", "c_levels"], "y", trees=20)[0].scores.first().accuracy > 0.9
    kind, coefficients, fit = ml.regression(x, ["n", "c_levels"], "y")
    assert kind == "logistic" and {r.feature for r in coefficients.collect()} == {"n", "intercept", *(f"c_levels[{i}]" for i in range(7))}
    assert ml.accuracy(ml.neural_net(x, ["n", "c_levels"], "y", iterations=60)[1]).first().accuracy > 0.9
    flags = features.encode_booleans(x)
    assert flags.schema["c_levels"].dataType == x.schema["c_levels"].dataType


def test_copies_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "COPIES", 100)
    df = spark.createDataFrame([(i, "many") for i in range(2500)] + [(9000, "few"), (9001, "few"), (9002, "few")], "row_id bigint, c string")
    out = features.oversample(df, "c").withColumn("task", F.spark_partition_id())
    sizes = {r.row_id: r for r in out.filter("c = 'few'").groupBy("row_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies"), F.count_distinct("task").alias("tasks")).collect()}
    assert sorted(r.n for r in sizes.values()) == [833, 833, 834] and all(r.n == r.copies and r.tasks > 1 for r in sizes.values())


DOCS = [(f"d{i}", {"mood": "sad" if i % 3 == 0 else "glad", "size": str(i)}) for i in range(30)]


@pytest.fixture(scope="module")
def linked(spark):
    docs = spark.createDataFrame(DOCS, "id string, metadata map<string,string>")
    rows = spark.createDataFrame([(r, float(r % 7), "a" if r % 3 == 0 else "b") for r in range(90)], "row_id bigint, v double, kind string")
    pairs = spark.createDataFrame([(f"d{r % 30}", r) for r in range(80)], "doc_id string, row_id bigint")
    hubs = linkage.HubLinks(
        spark.createDataFrame([(f"d{i}", str(i % 3)) for i in range(30)], "doc_id string, hub string"),
        spark.createDataFrame([(r, str(r % 3)) for r in range(80)], "row_id bigint, hub string"), "keyword",
    )
    return docs, rows, {"pairs": pairs, "hubs": hubs}


@pytest.mark.parametrize("kind", ["pairs", "hubs"])
def test_models_through_links(linked, kind):
    docs, rows, links = linked
    frame, names = features.linked_frame(docs, rows, links[kind], "mood", ["v", "kind"])
    assert names == ["v", "kind_b"] and frame.columns == ["row_id", "v", "kind_b", "mood"]
    assert {(r.row_id, r.mood) for r in frame.collect()} == {(r, 1.0 if r % 3 == 0 else 0.0) for r in range(80)}
    found = ml.through_links(ml.linear_svm, docs, rows, links[kind], "mood", ["v", "kind"])
    assert found.scores.first().accuracy == 1
    assert ml.through_links(ml.gradient_boosting, docs, rows, links[kind], "mood", ["kind"], rounds=3).scores.first().accuracy == 1
    assert ml.through_links(ml.kmeans, docs, rows, links[kind], "mood", ["v"], clusters=2)[1].count() == 2
    means, _ = features.linked_frame(docs, rows, links[kind], "size", ["v"], "mean")
    by_row = {r.row_id: r.size for r in means.collect()}
    assert by_row[31] == pytest.approx(1.0 if kind == "pairs" else sum(range(1, 30, 3)) / 10)
    balanced, _ = features.linked_frame(docs, rows, links[kind], "mood", ["v"], balance=True)
    n = {r.mood: (r.n, r.ids) for r in balanced.groupBy("mood").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("ids")).collect()}
    assert n[0.0] == n[1.0] == (53, 53)
