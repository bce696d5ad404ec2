"""Models on the numeric frame, with MLlib."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from inspect import signature
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textweave.functions.text import whitespace_tokens
from textweave.functions.vectors import euclidean_distance
from textweave.operators.features import binary_target, encode_booleans, linked_frame, standardise, train_test_split
from textweave.operators.linkage import HubLinks
from textweave.operators.stats import confusion
from textweave.operators.words import frequent_itemsets
from textweave.plans.lineage import cut_lineage
from textweave.plans.ordering import with_dense_index

RECORDS_PER_BLOCK = 1 << 20  # numbered records that one task pairs with others
PLACES = 1 << 40  # different places between split points that one number may tell


@F.udf(returnType=VectorUDT())
def _sparse(v):
    return SparseVector(v["size"], v["indices"], v["values"])


def _wide(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The sparse columns of ``one_hot`` among ``columns``."""
    return [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, StructType)]


def with_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse columns as vectors of the model library."""
    return df.withColumns({c: _sparse(c) for c in _wide(df, columns)})


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the vector ``features``; sparse columns count with all their places."""
    df = with_vectors(df, columns)
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def flip_signs(axes: np.ndarray) -> np.ndarray:
    """Make the largest loading of every column positive."""
    lead = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    return axes * np.where(lead < 0, -1.0, 1.0)


def principal_axes(df: DataFrame, vector: str, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of an array column (both of model size)."""
    vectors = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    model = PCA(k=dimensions, inputCol="v", outputCol="p").fit(vectors)
    return mean, flip_signs(model.pc.toArray())


def through_links(
    job: Callable, documents: DataFrame, rows: DataFrame, links: DataFrame | HubLinks, field: str, columns: Sequence[str],
    how: str = "majority", balance: bool = False, **options,
):
    """``job`` of this module on the rows that ``links`` of any kind connect with documents.

    The documents' metadata ``field`` is the outcome of jobs that have one, brought to a row by ``how`` (majority, mode,
    mean, first); the others get the linked rows alone. ``options`` go to the job.
    """
    frame, features = linked_frame(documents, rows, links, field, columns, how, balance)
    frame = cut_lineage(frame)  # read several times by every job
    if "outcome" in signature(job).parameters:
        return job(frame, features, field, **options)
    return job(frame, features, **options)


# -- clusters and neighbours ---------------------------------------------------------------------------------------


def kmeans(df: DataFrame, columns: Sequence[str], clusters: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame, float]:
    """Rows with ``metadata_cluster``, the centres (cluster, column, value) and the summed squared distance."""
    data = assemble(df, columns)
    model = KMeans(k=clusters, seed=seed, initMode="k-means||", predictionCol="metadata_cluster").fit(data)
    centres = [(i, c, float(v)) for i, centre in enumerate(model.clusterCenters()) for c, v in zip(columns, centre)]
    table = df.sparkSession.createDataFrame(centres, "cluster int, column string, value double")
    return model.transform(data).drop("features"), table, model.summary.trainingCost


def nearest_rows(df: DataFrame, columns: Sequence[str], record: int, n: int = 3, row_id: str = "row_id") -> DataFrame:
    """(row_id, distance): the ``n`` rows nearest to row ``record``, itself included."""
    vec = F.array(*[F.col(c).cast("double") for c in columns])
    probe = df.filter(F.col(row_id) == record).select(vec.alias("v")).first()  # one record, used as a constant
    if probe is None:
        raise ValueError(f"no record {record}")
    target = F.array(*[F.lit(x) for x in probe["v"]])
    return df.select(row_id, euclidean_distance(vec, target).alias("distance")).orderBy("distance", row_id).limit(n)


# -- classifiers ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Classified:
    """Fitted model, scored records (row_id, target, prediction) and their confusion scores."""

    model: object
    scored: DataFrame
    scores: DataFrame


def _classified(model, data: DataFrame, row_id: str) -> Classified:
    scored = model.transform(data).select(row_id, "target", F.col("prediction").cast("int").alias("prediction"))
    return Classified(model, scored, confusion(scored, "target", "prediction"))


def neural_net(df: DataFrame, columns: Sequence[str], outcome: str, iterations: int = 100, seed: int = 42, row_id: str = "row_id") -> tuple[object, DataFrame]:
    """Feed-forward net (12 and 8 hidden units for two classes, 64 and 32 for more) and training accuracy."""
    index = StringIndexer(inputCol=outcome, outputCol="_class", stringOrderType="alphabetAsc").fit(df)
    classes = len(index.labels)
    if classes < 2:
        raise ValueError("a class outcome with at least 2 values is needed")
    wide = _wide(df, columns)
    indexed = index.transform(standardise(df, [c for c in columns if c not in wide]))
    data = assemble(indexed, columns).withColumn("target", F.col("_class").cast("int"))
    hidden = [12, 8] if classes == 2 else [64, 32]
    inputs = data.select("features").first()["features"].size
    net = MultilayerPerceptronClassifier(
        layers=[inputs, *hidden, classes], maxIter=iterations, seed=seed, labelCol="target", featuresCol="features"
    )
    model = net.fit(data)
    scored = model.transform(data).select(row_id, "target", F.col("prediction").cast("int").alias("prediction"))
    return model, scored


def accuracy(scored: DataFrame) -> DataFrame:
    hit = (F.col("target") == F.col("prediction")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def linear_svm(df: DataFrame, columns: Sequence[str], outcome: str, test_share: float = 0.2, seed: int = 0, row_id: str = "row_id") -> Classified:
    """Linear support vector classifier on standardised features, scored on the held-out part."""
    train, test = train_test_split(with_vectors(binary_target(df, outcome), columns), test_share, seed, row_id)
    scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled")
    svm = LinearSVC(featuresCol="scaled", labelCol="target", maxIter=50, regParam=1e-3)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), scaler, svm]).fit(train)
    return _classified(model, test, row_id)


def random_forest(
    df: DataFrame, columns: Sequence[str], outcome: str, test_share: float = 0.5, seed: int = 1, trees: int = 100, row_id: str = "row_id"
) -> tuple[Classified, DataFrame]:
    """Forest of 100 trees scored on the held-out half; also returns that half with its features."""
    train, test = train_test_split(binary_target(df, outcome), test_share, seed, row_id)
    held_out = assemble(test, columns)
    forest = RandomForestClassifier(numTrees=trees, seed=seed, labelCol="target", featuresCol="features")
    return _classified(forest.fit(assemble(train, columns)), held_out, row_id), held_out


def impurity_importance(model, columns: Sequence[str], df: DataFrame) -> DataFrame:
    pairs = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(pairs, "feature string, importance double")


def split_points(model) -> list[np.ndarray] | None:
    """Ascending split points of each feature in a tree or forest; None for other models and for splits by category."""
    told = getattr(model, "toDebugString", None)
    if not isinstance(told, str) or " in {" in told:
        return None
    found: list[set[float]] = [set() for _ in range(model.numFeatures)]
    for f, point in re.findall(r"\(feature (\d+) <= ([^)]+)\)", told):
        found[int(f)].add(float(point))
    return [np.array(sorted(points)) for points in found]


def permutation_importance(
    classified: Classified, held_out: DataFrame, columns: Sequence[str], repeats: int = 10, seed: int = 1, row_id: str = "row_id"
) -> DataFrame:
    """(feature, importance): mean loss of accuracy when a feature is taken from another record.

    Records are numbered in hash order once; repeat r pairs record i with record i + shift(r), which is a permutation.
    Features that no tree splits on change nothing and are not scored. Trees only see between which split points a value
    lies, so records become one number of these places, and each different mixed number is scored once with its count.
    """
    impurity = getattr(classified.model, "featureImportances", None)
    used = list(range(len(columns))) if impurity is None else [int(i) for i in np.flatnonzero(impurity.toArray())]
    arrays = held_out.select(row_id, "target", vector_to_array("features").alias("x"), F.xxhash64(row_id, F.lit(seed)).alias("_h"))
    points = split_points(classified.model)
    if points is not None and math.prod(len(t) + 1 for t in points) < PLACES:
        per_feature = _shuffled_places(classified.model, arrays, points, used, repeats, seed, row_id)
    else:
        per_feature = _shuffled_records(classified.model, arrays, used, repeats, seed, row_id)
    names = F.array(*[F.lit(c) for c in columns])
    base = classified.scored.agg(F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("base")).withColumn("_k", F.lit(1))
    told = per_feature.withColumn("_k", F.lit(1)).join(F.broadcast(base), "_k").select(
        F.get(names, F.col("f")).alias("feature"), (F.col("base") - F.col("shuffled")).alias("importance")
    )
    idle = [(c, 0.0) for i, c in enumerate(columns) if i not in used]
    return told.unionByName(held_out.sparkSession.createDataFrame(idle, "feature string, importance double")) if idle else told


def _shifts(n: int, repeats: int, seed: int) -> list[int]:
    return [1 + (seed + r * 7919) % max(n - 1, 1) for r in range(repeats)]


def _shuffled_records(model, arrays: DataFrame, used: Sequence[int], repeats: int, seed: int, row_id: str) -> DataFrame:
    """(f, shuffled): accuracy with feature f of another record, every record scored for every feature and repeat."""
    numbered = with_dense_index(arrays, ["_h", row_id], "i").select("i", "target", "x")
    n = numbered.count()
    shift = F.explode(F.array(*[F.lit(s) for s in _shifts(n, repeats, seed)]))
    asked = numbered.withColumn("shift", shift).withColumn("j", F.pmod(F.col("i") + F.col("shift"), F.lit(n)))
    other = numbered.select(F.col("i").alias("j"), F.col("x").alias("other"))
    feature = F.explode(F.array(*[F.lit(i) for i in used]).cast("array<int>")).alias("f")
    mixed = asked.join(other, "j").select("target", "x", "other", feature)
    swapped = F.transform("x", lambda v, k: F.when(k == F.col("f"), F.get("other", k)).otherwise(v))
    scored = model.transform(mixed.select("f", "target", array_to_vector(swapped).alias("features")))
    return scored.groupBy("f").agg(F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("shuffled"))


def _shuffled_places(
    model, arrays: DataFrame, points: list[np.ndarray], used: Sequence[int], repeats: int, seed: int, row_id: str, block: int | None = None
) -> DataFrame:
    """The same for trees. A block of numbered records gets the records its own are paired with and counts what they give."""
    block = block or RECORDS_PER_BLOCK
    radix = np.array([len(t) + 1 for t in points], np.int64)
    unit = np.r_[1, np.cumprod(radix)[:-1]].astype(np.int64)
    kind = dict(arrays.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(points))
            code = sum((np.searchsorted(t, x[:, f], "left") * unit[f] for f, t in enumerate(points)), np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(row_id), batch.column("target"), batch.column("_h"), pa.array(code)], [row_id, "target", "_h", "code"])

    placed = arrays.mapInArrow(place, f"`{row_id}` {kind[row_id]}, target {kind['target']}, _h bigint, code bigint")
    numbered = cut_lineage(with_dense_index(placed, ["_h", row_id], "i").select("i", F.col("target").cast("double").alias("target"), "code"))
    n = numbered.count()
    shifts = _shifts(n, repeats, seed)
    asked_by = F.array_distinct(F.array(*[F.floor(F.pmod(F.col("i") - s, F.lit(n)) / block).cast("bigint") for s in (0, *shifts)]))

    def count(records: pa.Table) -> pa.Table:
        number = int(records.column("block")[0].as_py())
        records = records.sort_by("i")
        i, code = records.column("i").to_numpy(), records.column("code").to_numpy()
        target, kind_of = np.unique(records.column("target").to_numpy(), return_inverse=True)
        low, high = np.searchsorted(i, [number * block, (number + 1) * block])
        own, kinds = code[low:high], kind_of[low:high]
        told: list[tuple[int, np.ndarray, np.ndarray]] = []
        for f in used:
            digit = code // unit[f] % radix[f]
            rest = own - digit[low:high] * unit[f]
            keys = [(rest + digit[np.searchsorted(i, (i[low:high] + s) % n)] * unit[f]) * len(target) + kinds for s in shifts]
            told.append((f, *np.unique(np.concatenate(keys), return_counts=True)))
        f = np.repeat([t[0] for t in told], [len(t[1]) for t in told]).astype(np.int32)
        key, many = np.concatenate([t[1] for t in told]), np.concatenate([t[2] for t in told])
        return pa.table([pa.array(f), pa.array(key // len(target)), pa.array(target[key % len(target)], from_pandas=True), pa.array(many.astype(np.int64))], ["f", "code", "target", "n"])

    def stand_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record for each number: the split points themselves, or what follows the last."""
        ends = [np.r_[t, np.nextafter(t[-1], np.inf)] if len(t) else np.zeros(1) for t in points]
        for batch in batches:
            code = batch.column("code").to_numpy()
            x = np.stack([e[code // u % r] for e, u, r in zip(ends, unit, radix)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "x"])

    empty = not n or not used
    met = numbered.limit(0) if empty else numbered
    counted = met.withColumn("block", F.explode(asked_by) if not empty else F.lit(0)).groupBy("block").applyInArrow(count, "f int, code bigint, target double, n bigint")
    summed = counted.groupBy("f", "code", "target").agg(F.sum("n").alias("n"))
    stood = summed.mapInArrow(stand_in, "f int, code bigint, target double, n bigint, x array<double>")
    scored = model.transform(stood.select("f", "target", "n", array_to_vector("x").alias("features")))
    valid = F.col("target").isNotNull()
    hits = F.sum(F.when(F.col("prediction") == F.col("target"), F.col("n")).otherwise(0))
    return scored.groupBy("f").agg((hits.cast("double") / F.sum(F.when(valid, F.col("n")))).alias("shuffled"))


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def gradient_boosting(
    df: DataFrame, columns: Sequence[str], outcome: str, test_share: float = 0.2, seed: int = 42, rounds: int = 20, row_id: str = "row_id"
) -> Classified:
    """Boosted trees for "outcome equals 1", scored on the held-out part."""
    flagged = df.withColumn("target", F.coalesce((F.col(outcome) == 1).cast("int"), F.lit(0)))
    train, test = train_test_split(flagged, test_share, seed, row_id)
    model = GBTClassifier(maxIter=rounds, seed=seed, labelCol="target", featuresCol="features").fit(assemble(train, columns))
    return _classified(model, assemble(test, columns), row_id)


def column_itemsets(df: DataFrame, min_support: float = 0.9) -> DataFrame:
    """Sets of columns that are true together in at least ``min_support`` of the records."""
    flags = encode_booleans(df)
    items = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in flags.columns]))
    return frequent_itemsets(flags.select(items.alias("items")), min_support)


def column_rules(df: DataFrame, min_support: float = 0.9, min_confidence: float = 0.5) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift): which columns are true where others are, one consequent each."""
    flags = encode_booleans(df)
    items = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in flags.columns]))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(flags.select(items.alias("items")))
    return model.associationRules.select(F.array_sort("antecedent").alias("antecedent"), F.get("consequent", F.lit(0)).alias("consequent"), "support", "confidence", "lift")


# -- principal components ------------------------------------------------------------------------------------------


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, value): sample covariance of the standardised columns, upper triangle with diagonal, one pass."""
    z = standardise(df, columns)
    pairs = list(combinations_with_replacement(columns, 2))
    wide = z.agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


@dataclass(frozen=True)
class Components:
    values: DataFrame  # component, eigenvalue, percent, cumulative
    loadings: DataFrame  # component, column, loading
    scores: DataFrame  # row_id, pc1..pcn


def principal_components(df: DataFrame, columns: Sequence[str], n: int = 3, row_id: str = "row_id") -> Components:
    """Eigenvalues, loadings and scores; the decomposed matrix has one entry per pair of columns."""
    d = len(columns)
    n = max(1, min(n, d))
    at = {c: i for i, c in enumerate(columns)}
    matrix = np.zeros((d, d))
    for r in covariance(df, columns).collect():  # d * (d + 1) / 2 numbers
        matrix[at[r["a"]], at[r["b"]]] = matrix[at[r["b"]], at[r["a"]]] = r["value"]
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, axes = values[order], flip_signs(axes[:, order])
    spark = df.sparkSession
    share = values / values.sum() * 100.0
    table = spark.createDataFrame(
        [(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(values, share))], "component int, eigenvalue double, percent double"
    ).withColumn("cumulative", F.sum("percent").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))
    loads = spark.createDataFrame(
        [(k + 1, c, float(axes[i, k])) for k in range(n) for i, c in enumerate(columns)], "component int, column string, loading double"
    )

    def score(k: int) -> Column:
        out = F.lit(0.0)
        for i, c in enumerate(columns):
            out = out + F.col(c) * float(axes[i, k])
        return out.alias(f"pc{k + 1}")

    return Components(table, loads, standardise(df, columns).select(row_id, *[score(k) for k in range(n)]))


# -- regression and text convergence -------------------------------------------------------------------------------


def regression(df: DataFrame, columns: Sequence[str], outcome: str) -> tuple[str, DataFrame, DataFrame]:
    """("logistic" or "linear", coefficients, scores on the training data).

    A sparse column has one coefficient per place, named by column and place.

    An outcome with exactly two values is logistic with the usual unit ridge penalty, any other linear.
    """
    values = [r[0] for r in df.select(outcome).filter(F.col(outcome).isNotNull()).distinct().limit(3).collect()]
    spark = df.sparkSession
    if len(values) == 2:
        data = assemble(binary_target(df, outcome), columns)
        size = data.count()
        model = LogisticRegression(
            maxIter=1000, regParam=1.0 / size, standardization=False, labelCol="target", featuresCol="features"
        ).fit(data)
        scored = model.transform(data).select("target", F.col("prediction").cast("int").alias("prediction"))
        kind, fit = "logistic", accuracy(scored).select("accuracy")
    else:
        data = assemble(df, columns).withColumn("target", F.col(outcome).cast("double"))
        model = LinearRegression(solver="normal", regParam=0.0, labelCol="target", featuresCol="features").fit(data)
        error = F.col("target") - F.col("prediction")
        fit = model.transform(data).agg(
            F.avg(error * error).alias("mse"), (1 - F.sum(error * error) / (F.var_pop("target") * F.count(F.lit(1)))).alias("r2")
        )
        kind = "linear"
    sizes = df.select(*[F.col(f"{c}.size").alias(c) for c in _wide(df, columns)]).first()
    names = [n for c in columns for n in ([c] if sizes is None or c not in sizes else [f"{c}[{i}]" for i in range(sizes[c])])]
    pairs = [(c, float(v)) for c, v in zip(names, model.coefficients.toArray())] + [("intercept", float(model.intercept))]
    return kind, spark.createDataFrame(pairs, "feature string, coefficient double"), fit


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of one feature: slope, intercept, R^2, mean squared error."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.filter(xd.isNotNull() & yd.isNotNull()).agg(
        F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept"), F.regr_r2(yd, xd).alias("r2"),
        F.var_pop(yd).alias("_v"), F.count(F.lit(1)).alias("n"),
    )
    return s.select("slope", "intercept", "r2", ((1 - F.col("r2")) * F.col("_v")).alias("mse"), "n")


def text_convergence(aligned: DataFrame, test_share: float = 0.2, seed: int = 42, features: int = 1 << 16) -> DataFrame:
    """Can the text predict the outcome? Scores of a linear text classifier on both parts of ``aligned``.

    ``aligned(doc_id, text, outcome)`` must have a two-valued outcome.
    """
    values = aligned.select("outcome").filter(F.col("outcome").isNotNull()).distinct().limit(3).count()
    if values != 2:
        raise ValueError("the outcome must have exactly two values")
    data = binary_target(aligned.filter(F.col("outcome").isNotNull()), "outcome").withColumn("tokens", whitespace_tokens("text"))
    train, test = train_test_split(data, test_share, seed, "doc_id")
    stages = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="target", featuresCol="features", maxIter=50, regParam=0.01),
    ]
    model = Pipeline(stages=stages).fit(train)
    parts = [
        confusion(model.transform(part).select("target", F.col("prediction").cast("int").alias("prediction")), "target", "prediction")
        .withColumn("part", F.lit(name))
        for name, part in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])
