"""Operators on small hand-made inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.functions.text import chunks, remove_words, sentences
from textweave.functions.time import parse_timestamp
from textweave.operators import ballmapper, features, filters, graph, linkage, ml, network, sentiment, stats, temporal, topics
from textweave.plans.lineage import written
from textweave.sources.ingest import as_documents


def docs_of(spark, rows):
    """Documents from (id, text, time or None, metadata)."""
    raw = spark.createDataFrame(rows, "id string, text string, t string, m map<string,string>")
    return as_documents(raw, F.col("id"), F.col("text"), parse_timestamp("t"), F.col("m"))


@pytest.fixture(scope="module")
def timed(spark):
    docs = docs_of(
        spark,
        [
            ("doc1", "first", "2025-01-15T10:00:00", {"sentiment": "pos", "mood": "a"}),
            ("doc2", "second", "2025-01-15T10:30:00", {"sentiment": "neg", "mood": "b"}),
            ("doc3", "third", "2025-01-16T11:00:00", {"sentiment": "neu", "mood": "a"}),
            ("doc4", "fourth", None, {}),
        ],
    )
    rows = spark.createDataFrame(
        [(0, 100, "2025-01-15 10:05:00"), (1, 200, "2025-01-15 10:35:00"), (2, 300, "2025-01-15 11:10:00")], "row_id bigint, value int, t string"
    ).select("row_id", "value", F.col("t").cast("timestamp_ntz").alias("ts"))
    return docs, rows


def test_time_links(timed):
    docs, rows = timed
    near = {(r.doc_id, r.row_id, r.gap) for r in linkage.link_by_nearest_time(docs, rows).collect()}
    assert ("doc1", 0, 300.0) in near and ("doc2", 1, 300.0) in near and len(near) == 3
    assert linkage.link_by_nearest_time(docs, rows, max_gap=0).count() == 0
    window = {(r.doc_id, r.row_id, r.gap) for r in linkage.link_by_time_window(docs, rows, before=600, after=600).collect()}
    assert window == {("doc1", 0, 300.0), ("doc2", 1, 300.0)}


def test_period_links_keep_every_pair(timed):
    docs, rows = timed
    hubs = linkage.link_by_period(docs, rows, period="D")
    assert {(r.doc_id, r.n_links) for r in hubs.counts().collect()} == {("doc1", 3), ("doc2", 3)}
    assert {(r.doc_id, r.row_id) for r in hubs.pairs().collect()} == {(d, r) for d in ("doc1", "doc2") for r in range(3)}
    assert {r.row_id for r in filters.rows_linked_from(rows, docs, hubs).collect()} == {0, 1, 2}
    assert {r.id for r in filters.documents_linked_to(docs, rows, hubs).collect()} == {"doc1", "doc2"}
    assert {r.value for r in linkage.text_outcome(docs, hubs, "mood", "majority").collect()} == {"a"}


def test_time_range_keeps_undated(timed):
    docs, rows = timed
    kept = filters.in_time_range(docs, "ts", "2025-01-15 10:20:00", "2025-01-15 10:40:00")
    assert {r.id for r in kept.collect()} == {"doc2", "doc4"}
    assert filters.in_time_range(rows, "ts", "2025-01-15 10:20:00", "2025-01-15 10:40:00").count() == 1


def test_sentiment_trend(timed):
    got = {r.period: (r.sentiment_score, r.document_count) for r in temporal.sentiment_trend(timed[0], "D").collect()}
    assert got == {"2025-01-15": (0.0, 2), "2025-01-16": (0.0, 1)}


def test_topics_prefer_listed_ones(spark):
    docs = docs_of(spark, [("1", "alpha alpha beta", "2025-01-15", {}), ("2", "gamma", "2025-01-16", {})]).withColumn(
        "topics", F.when(F.col("id") == "2", F.array(F.lit("listed")))
    )
    got = {r.period: r.topics for r in temporal.topic_lists(docs, [], "W", 3, "topics").collect()}
    assert got == {"2025-01-13/2025-01-19": ["listed"]}
    plain = {r.period: r.topics for r in temporal.topic_lists(docs, ["with"], "D", 1).collect()}
    assert plain == {"2025-01-15": ["alpha"], "2025-01-16": ["gamma"]}


def test_reducer(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "a", 3), (1, "b", 4), (2, "7", 1), (2, "9", 2)], "row_id bigint, value string, order int")
    pick = lambda how: {r.row_id: r.value for r in linkage.reduce_values(df, ["row_id"], how).collect()}
    assert pick("majority") == {1: "b", 2: "7"}  # equally frequent: first seen wins
    assert pick("first") == {1: "b", 2: "7"}
    assert pick("mean") == {1: "b", 2: "8.0"}


def test_metadata_export_is_an_outer_join(spark):
    docs = docs_of(spark, [("1", "x", None, {"k": "v", "score": "s"}), ("3", "y", None, {"k": "w"})])
    rows = spark.createDataFrame([(1, 5), (2, 6)], "id int, score int")
    got = {r.id: (r.score, r.score_metadata, r.k) for r in linkage.metadata_export(docs, rows, ["k", "score"]).collect()}
    assert got == {"1": (5, "s", "v"), "2": (6, None, None), "3": (None, None, "w")}


def test_filter_language_rejects_malformed(timed):
    with pytest.raises(ValueError):
        filters.apply_filters(*timed, ["nothing"])


def test_text_functions(spark):
    df = spark.createDataFrame([("été Summer ÉTÉ summertime. Next one! 3 more",)], "t string")
    row = df.select(remove_words("t", ["été", "summer"]).alias("r"), sentences("t").alias("s"), chunks("t", 20, 5).alias("c")).first()
    assert row.r == "   summertime. Next one! 3 more"
    assert row.s == ["été Summer ÉTÉ summertime.", "Next one!", "3 more"]
    assert [len(c) for c in row.c] == [20, 20, 13] and row.c[0][-5:] == row.c[1][:5]


def test_dates(spark):
    cases = ["2025-01-15T10:30:00Z", "01/15/2025", "15/01/2025", "1-5-99", "31/31/2025", "soon", None, "2025-13-01"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(parse_timestamp("t")).collect()]
    assert [g and g.isoformat()[:16] for g in got] == ["2025-01-15T10:30", "2025-01-15T00:00", "2025-01-15T00:00", "1999-01-05T00:00", None, None, None, None]


def test_binning_and_scaling(spark):
    df = spark.createDataFrame([(float(v), 3.0) for v in (0, 1, 5, 9, 10)], "x double, c double")
    assert [r.x for r in features.bin_column(df, "x", 2).collect()] == [0, 0, 0, 1, 1]
    assert {r.c for r in features.bin_column(df, "c", 4).collect()} == {1}
    assert {r.c for r in features.min_max(df, ["x", "c"]).collect()} == {0.5}


def test_oversample_keeps_every_record(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(95)], "row_id bigint, y string")
    counts = {(r.y, r.row_id): r["count"] for r in features.oversample(df, "y").groupBy("y", "row_id").count().collect()}
    assert len(counts) == 95
    assert sum(n for (y, _), n in counts.items() if y == "small") == sum(n for (y, _), n in counts.items() if y == "big") == 85
    small = [n for (y, _), n in counts.items() if y == "small"]
    assert max(small) - min(small) <= 1


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 9, 120).astype(float), rng.integers(0, 9, 120).astype(float)
    rows = [(float(x), None if i % 10 == 0 else float(y), float(x + y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    frame = df.toPandas()

    def tau(x, y):
        dx, dy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
        return (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())

    def rho(x, y):
        return np.corrcoef(x.rank(), y.rank())[0, 1]

    for method, one in (("kendall", lambda x, y: tau(x.to_numpy(), y.to_numpy())), ("spearman", rho), ("pearson", lambda x, y: np.corrcoef(x, y)[0, 1])):
        for r in stats.correlation_pairs(df, ["a", "b", "c"], method).collect():
            both = frame[[r.variable_1, r.variable_2]].dropna()
            assert r.correlation == pytest.approx(one(both[r.variable_1], both[r.variable_2])), method


def test_similar_sentences_against_brute_force(spark):
    rng = random.Random(8)

    def change(x):
        x = list(x)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice(["", "a", "bc"])
        return "".join(x)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    base = ["the common opening " + "".join(rng.choice("abcde ") for _ in range(rng.randint(4, 40))) for _ in range(25)]
    texts = sorted({t for b in base for t in (b, change(b), change(b))})
    df = spark.createDataFrame([(t,) for t in texts], "sentence string")
    for least in (0.9, 0.75):
        want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if distance(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9)}
        assert {(r.source, r.target) for r in network.similarity_edges(df, least).collect()} == want


def test_cooccurrence_window(spark):
    df = spark.createDataFrame([("d", ["a", "b", "a", "c"]), ("e", [])], "doc_id string, lemmas array<string>")
    got = {(r.source, r.target): r.weight for r in network.cooccurrence_edges(df, 3).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("a", "a"): 1, ("b", "c"): 1}


def test_sentiment_rules(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "form string, valence double")
    docs = docs_of(spark, [("p", "A good day", None, {}), ("n", "It is not good", None, {}), ("b", "A very good day!", None, {}), ("c", "good but bad", None, {}), ("z", "", None, {})])
    got = {r.doc_id: r for r in sentiment.sentiment_scores(docs, lex).collect()}
    norm = lambda s: s / (s * s + 15) ** 0.5
    assert got["p"].compound == pytest.approx(norm(2.0))
    assert got["n"].compound == pytest.approx(norm(2 * -0.74))
    assert got["b"].compound == pytest.approx(norm(2 + 0.293 + 0.292))
    assert got["c"].compound == pytest.approx(norm(2 * 0.5 - 2 * 1.5))
    assert got["z"].compound == 0 and got["z"].neu == 0


def test_graph(spark):
    docs = docs_of(spark, [("d1", "x", "2025-01-15", {"cluster": "0"}), ("d2", "y", "2025-02-15", {"cluster": "1"})]).withColumn(
        "keywords", F.when(F.col("id") == "d1", F.array(F.lit("k1"), F.lit("k2"))).otherwise(F.array(F.lit("k2")))
    )
    rows = spark.createDataFrame([(0, "d1", 5), (1, "d2", None)], "row_id bigint, id string, score int")
    g = graph.build_graph(docs, rows)
    labels = {(r.label, r["count"]) for r in g.nodes.groupBy("label").count().collect()}
    assert labels == {("document", 2), ("keyword", 2), ("cluster", 2), ("metadata", 1)}
    edges = {(r.label, r["count"]) for r in g.edges.groupBy("label").count().collect()}
    assert ("HAS_KEYWORD", 3) in edges and ("BELONGS_TO_CLUSTER", 2) in edges and ("HAS_METADATA", 2) in edges and ("CLUSTER_HAS_KEYWORD", 3) in edges
    only = graph.filter_nodes(g, ["document", "keyword", "odd"])
    assert {r.label for r in only.edges.collect()} == {"HAS_KEYWORD"}
    members, inside = graph.temporal_subgraphs(g, docs, "M")
    assert {r.id for r in members.filter("period = '2025-01'").collect()} == {"d1", "keyword:k1", "keyword:k2", "cluster:0", "metadata:d1"}
    blocks = {r.label: r.n_edges for r in graph.complete_edges(g.nodes).collect()}
    assert blocks == {"CLUSTER_HAS_KEYWORD": 4, "KEYWORD_HAS_METADATA": 2, "CLUSTER_HAS_METADATA": 2}
    with pytest.raises(ValueError):
        graph.build_graph(docs.withColumn("keywords", F.lit(None).cast("array<string>")), rows)


def test_ball_cover_does_not_depend_on_the_round(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.uniform(0, 10, 3))) for i in range(400)] + [(1000, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, y double")
    balls = ballmapper.ball_map(df, "y", ["a", "b"], 0.2)
    assert {r.row_id for r in balls.members.collect()} == set(range(400))
    small = ballmapper.cover(balls.points, 0.2, per_cell=1)
    assert [tuple(r) for r in small.orderBy("ball_no").collect()] == [tuple(r) for r in balls.landmarks.orderBy("ball_no").collect()]
    where = np.array([r.location for r in balls.landmarks.collect()])
    apart = np.sqrt(((where[:, None] - where[None]) ** 2).sum(-1))
    assert apart[np.triu_indices(len(where), 1)].min() > 0.2
    both = {(r.ball_id, r.other) for r in ballmapper.connection_lists(balls.edges).collect()}
    assert both == {(b, a) for a, b in both}
    with pytest.raises(ValueError):
        ballmapper.validate(df.withColumn("two", F.col("row_id") % 2), "two", ["a"])


def test_models(spark):
    rng = np.random.default_rng(10)
    rows = [(i, float(x), float(z), float(3 * x + 1), int(x > 0)) for i, (x, z) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "row_id bigint, x double, z double, y double, c int")
    kind, coefficients, fit = ml.regression(df, ["x", "z"], "y")
    values = {r.feature: r.coefficient for r in coefficients.collect()}
    assert kind == "linear" and values["x"] == pytest.approx(3) and values["intercept"] == pytest.approx(1) and fit.first().r2 == pytest.approx(1)
    assert ml.regression(df, ["x", "z"], "c")[0] == "logistic"
    classified, held_out = ml.random_forest(df, ["x", "z"], "c", trees=10)
    best = ml.top_features(ml.permutation_importance(classified, held_out, ["x", "z"], repeats=3), 1).first()
    assert best.feature == "x" and best.importance > 0.2
    assert ml.linear_svm(df, ["x", "z"], "c").scores.first().accuracy > 0.9
    parts = ml.principal_components(df, ["x", "z", "y"], 2)
    assert parts.values.orderBy("component").collect()[-1].cumulative == pytest.approx(100)
    assert ml.principal_components(df, ["x", "z", "y"], 9).loadings.count() == 9


def test_topics_weights_sum_to_one(spark):
    lists = spark.createDataFrame([(f"d{i}", ["apple", "pear"] * 5 if i % 2 else ["bolt", "nut"] * 5) for i in range(20)], "doc_id string, lemmas array<string>")
    fitted = topics.fit_topics(lists, topics=2, passes=5)
    for r in fitted.scored.collect():
        assert sum(r.weights) == pytest.approx(1)
    words = topics.topic_words(fitted, 2)
    main = topics.dominant_topics(fitted.scored, words)
    assert main.filter("keywords is not null").count() == 20
    assert topics.coherence(words, lists).count() == 2


def test_no_cut_where_the_data_is_large(spark):
    from textweave.functions import metadata, text
    from textweave.operators import features
    from textweave.sources import ingest

    one = spark.createDataFrame([("Straße groß Привет 日本. Really?! Yes.", '{"a":"[note] x","b":[1],"c":{"d":1},"e":null,"f":2}')], "t string, j string")
    got = one.select(text.words("t").alias("w"), text.sentences("t").alias("s"), metadata.json_scalars("j").alias("j")).first()
    assert got.w == ["straße", "groß", "привет", "日本", "really", "yes"]
    assert got.s == ["Straße groß Привет 日本.", "Really?!", "Yes."] and got.j == {"a": "[note] x", "f": "2"}
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("x").alias("text"))
    assert [len(r.text) for r in ingest.conversations_to_documents(turns).collect()] == [39_999]
    names = [f"w{i:02d}" for i in range(70)]
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate(names)] + [(1, i, w) for i, w in enumerate(names[:50])], "topic int, rank int, word string")
    shared = spark.createDataFrame([("a", names), ("b", ["other"])], "doc_id string, lemmas array<string>")
    npmi = {r.topic: r.npmi for r in topics.coherence(words, shared).collect()}
    assert npmi[0] == pytest.approx(npmi[1]) and npmi[0] == pytest.approx(1)
    docs = spark.createDataFrame([("1", {"mood": "sad"}), ("2", {"mood": "glad"}), ("3", {"mood": "glad"})], "id string, metadata map<string,string>")
    rows = spark.createDataFrame([(i, float(i)) for i in range(3)], "row_id bigint, v double")
    links = spark.createDataFrame([("1", 0), ("2", 1), ("3", 2)], "doc_id string, row_id bigint")
    try:
        x, outcome = features.linked_xy(docs, rows, links, "mood")
    except Exception as e:  # the message names the missing column
        raise AssertionError(str(e)[:500]) from e
    assert sorted(r.outcome for r in outcome.collect()) == [0.0, 0.0, 1.0]


def test_first_document_is_the_first_that_came_in(spark):
    docs = spark.createDataFrame([("10", {"m": "late"}), ("2", {"m": "early"}), ("x", {"m": "named"})], "id string, metadata map<string,string>")
    links = spark.createDataFrame([("10", 1), ("2", 1), ("x", 1), ("x", 2), ("10", 2)], "doc_id string, row_id bigint")
    assert {r.row_id: r.value for r in linkage.text_outcome(docs, links, "m", "first").collect()} == {1: "early", 2: "late"}
    assert linkage.metadata_export(docs, None).columns == ["id", "m"]


def test_rules_and_idle_features(spark):
    flags = spark.createDataFrame([(1, 1, 0)] * 6 + [(1, 0, 0)] * 2 + [(0, 1, 1)] * 2, "a int, b int, c int")
    got = {(tuple(r.antecedent), r.consequent): (r.support, r.confidence, r.lift) for r in ml.column_rules(flags, 0.5, 0.5).collect()}
    assert set(got) == {(("a",), "b"), (("b",), "a")} and got[("a",), "b"] == pytest.approx((0.6, 0.75, 0.75 / 0.8))
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 10).alias("x"), F.lit(1.0).alias("idle"), (F.col("id") % 10 >= 5).cast("int").alias("y"))
    classified, held_out = ml.random_forest(df, ["x", "idle"], "y", trees=5)
    told = {r.feature: r.importance for r in ml.permutation_importance(classified, held_out, ["x", "idle"], repeats=2).collect()}
    assert told["idle"] == 0 and told["x"] > 0.2


def test_keywords_given_as_comma_text(spark):
    docs = spark.createDataFrame([("keyword:odd", "n", "t", {"cluster": "0"}, "k1, k2,,k1")], "id string, name string, text string, metadata map<string,string>, keywords string")
    dated = docs.withColumn("ts", F.lit("2025-01-02").cast("timestamp_ntz"))
    built = graph.build_graph(dated)
    assert {r.target for r in built.edges.filter("label = 'HAS_KEYWORD'").collect()} == {"keyword:k1", "keyword:k2"}
    members, edges = graph.temporal_subgraphs(built, dated, "M")  # an id that looks like a keyword is still a document
    assert {r.id for r in members.collect()} == {"keyword:odd", "keyword:k1", "keyword:k2", "cluster:0"}
    assert {(r.source, r.target) for r in edges.collect()} >= {("keyword:odd", "keyword:k1"), ("cluster:0", "keyword:k2")}


def test_permuted_features_are_scored_by_place(spark, monkeypatch):
    """As scoring every record for every feature and repeat; only different places between split points are scored."""
    rng = np.random.default_rng(12)
    rows = [(i, float(round(x, 1)), float(z), 0.5, int(x + z / 4 > 0)) for i, (x, z) in enumerate(rng.normal(size=(500, 2)))]
    df = spark.createDataFrame(rows, "row_id bigint, x double, z double, idle double, c int")
    classified, held_out = ml.random_forest(df, ["x", "z", "idle"], "c", trees=5)
    arrays = held_out.select("row_id", "target", ml.vector_to_array("features").alias("x"), F.xxhash64("row_id", F.lit(1)).alias("_h"))
    want = {r.f: r.shuffled for r in ml._shuffled_records(classified.model, arrays, [0, 1], 4, 1, "row_id").collect()}
    points = ml.split_points(classified.model)
    assert len(points) == 3 and len(points[0]) and not len(points[2])
    for block in (64, 1 << 20):
        assert {r.f: r.shuffled for r in ml._shuffled_places(classified.model, arrays, points, [0, 1], 4, 1, "row_id", block).collect()} == want
    monkeypatch.setattr(ml, "_shuffled_records", None)
    base = classified.scores.first().accuracy
    told = {r.feature: r.importance for r in ml.permutation_importance(classified, held_out, ["x", "z", "idle"], repeats=4).collect()}
    assert told == pytest.approx({"x": base - want[0], "z": base - want[1], "idle": 0})


@pytest.mark.parametrize("held", [graph.HELD, 1])
def test_links_are_not_shuffled_for_their_rows(spark, monkeypatch, held):
    """Links grow with documents times rows; only the rows that have a node move to them, unless these are very many."""
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(graph, "written", lambda df, label: [labels.append(label), written(df, label)][1])
    labels = []
    docs = spark.createDataFrame([("1", "a", "x", {"lang": "en"}, "k"), ("2", "b", "y", {}, None)], "id string, name string, text string, metadata map<string,string>, keywords string")
    rows = spark.createDataFrame([(1, 1, 5), (2, 2, None), (3, None, 7), (3, 9, 8), (None, 4, 2)], "row_id int, id int, q int")
    built = graph.build_graph(docs, rows, require_keywords=False)
    assert labels == ["graph-core", "graph-nodes", "graph-edges"]
    links = spark.createDataFrame([("1", 1, "w", 2.0), ("2", 1, "w", None), ("1", 2, "w", 1.0), ("2", 3, "w", 4.0), ("2", None, "w", 4.0)], "doc_id string, row_id int, link_type string, gap double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.temporal_edges(built, links, rows)
        got = sorted((r.source, r.target, r.properties["time_gap"]) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("1", "metadata:1", "2.0"), ("2", "metadata:1", "0.0"), ("2", "metadata:9", "4.0")]
    assert ("hashpartitioning(row_id" in plan) == (held == 1)
