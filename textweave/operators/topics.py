"""Topic models, topic tables, and clusters of averaged word vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweave.operators import lda
from textweave.operators.coherence import coherence, coherence_cv  # noqa: F401
from textweave.plans.lineage import cut_lineage

LEAST_WEIGHT = 0.01  # topics below this weight are not listed for a document
WELL_SEPARATED = 0.35


@dataclass(frozen=True)
class TopicModel:
    """Fitted topics with the documents' weights; everything of vocabulary size is a table."""

    model: lda.Lda
    documents: DataFrame  # doc_id, gamma, bound
    scored: DataFrame  # doc_id, weights array<double>

    @property
    def log_perplexity(self) -> float:
        """Lower bound of the log likelihood per word."""
        return self.model.word_bound(self.documents)


def fit_topics(
    lemmas: DataFrame, topics: int = 8, passes: int = 15, vocabulary_size: int | None = None, min_documents: int = 1,
    seed: int = 42, tokens: str = "lemmas",
) -> TopicModel:
    """Topics of ``lemmas(doc_id, lemmas)``, over every word unless ``vocabulary_size`` limits them.

    A document without a word has equal weights.
    """
    model = lda.fit(lemmas, topics, passes, vocabulary_size, min_documents, seed, tokens)
    documents = cut_lineage(model.document_weights())
    total = F.aggregate("gamma", F.lit(0.0), lambda a, x: a + x)
    equal = F.array_repeat(F.lit(1.0 / topics), topics)
    weights = F.coalesce(F.transform("gamma", lambda x: x / total), equal)
    scored = lemmas.select("doc_id").distinct().join(documents.select("doc_id", "gamma"), "doc_id", "left")
    return TopicModel(model, documents, scored.select("doc_id", weights.alias("weights")))


def topic_words(fitted: TopicModel, n: int = 8) -> DataFrame:
    """(topic, rank, word, weight): the ``n`` heaviest words of each topic; every task passes on its own ``n`` best."""
    cells = fitted.model.shares().select("word", F.posexplode("phi").alias("topic", "weight"))
    best = Window.partitionBy("topic").orderBy(F.col("weight").desc(), "word")
    return cells.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("topic", "rank", "word", "weight")


def document_topics(scored: DataFrame, least: float = LEAST_WEIGHT) -> DataFrame:
    """(doc_id, topic, weight) of the topics with a noticeable weight."""
    return scored.select("doc_id", F.posexplode("weights").alias("topic", "weight")).filter(F.col("weight") >= least)


def dominant_topics(scored: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, topic, weight, keywords): the heaviest topic, its weight to 4 digits, its words joined by comma."""
    weight = F.array_max("weights")
    main = scored.select("doc_id", (F.array_position("weights", weight) - 1).cast("int").alias("topic"), F.round(weight, 4).alias("weight"))
    if words is None:
        return main
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    text = words.groupBy("topic").agg(F.array_join(F.transform(ordered, lambda w: w["word"]), ", ").alias("keywords"))
    return main.join(F.broadcast(text), "topic", "left").select("doc_id", "topic", "weight", "keywords")


def representative_documents(dominant: DataFrame) -> DataFrame:
    """The document with the largest weight of each topic."""
    best = Window.partitionBy("topic").orderBy(F.col("weight").desc(), "doc_id")
    return dominant.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1).drop("_r")


def topics_of_slice(scored: DataFrame, index: DataFrame, start: int = 0, end: int = 1) -> DataFrame:
    """Dominant topic and full weights of the documents at positions start..end-1 of ``index(doc_id, position)``."""
    chosen = index.filter((F.col("position") >= start) & (F.col("position") < end))
    kept = scored.join(chosen, "doc_id")
    main = (F.array_position("weights", F.array_max("weights")) - 1).cast("int")
    return kept.select("position", "doc_id", main.alias("topic"), "weights")


def discussed_topics(scored: DataFrame, words: DataFrame, n_words: int = 3) -> DataFrame:
    """(topic, documents, total_weight, words): documents dominated by it, summed weight, first words."""
    total = scored.select(F.posexplode("weights").alias("topic", "w")).groupBy("topic").agg(F.sum("w").alias("total_weight"))
    main = dominant_topics(scored).groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    first = words.filter(F.col("rank") <= n_words).groupBy("topic").agg(F.array_join(F.transform(ordered, lambda w: w["word"]), ", ").alias("words"))
    return total.join(main, "topic", "left").join(first, "topic", "left").select(
        "topic", F.coalesce("documents", F.lit(0)).alias("documents"), "total_weight", "words"
    )


def word_importance(words: DataFrame, lemmas: DataFrame, tokens: str = "lemmas") -> DataFrame:
    """(topic, word, weight, word_count): topic words with their corpus counts, 0 when absent."""
    wanted = words.select("word").distinct()
    counted = lemmas.select(F.explode(tokens).alias("word")).join(wanted, "word").groupBy("word").agg(F.count(F.lit(1)).alias("word_count"))
    return words.join(counted, "word", "left").select("topic", "word", "weight", F.coalesce("word_count", F.lit(0)).alias("word_count"))


def token_topics(fitted: TopicModel, index: DataFrame, start: int = 0, end: int = 10) -> DataFrame:
    """(doc_id, word, topic): the likeliest topic of every vocabulary word of a slice of documents."""
    chosen = index.filter((F.col("position") >= start) & (F.col("position") < end)).select("doc_id")
    cells = fitted.model.cells.join(chosen, "doc_id", "left_semi").select("doc_id", "term")
    met = cells.join(fitted.model.shares(), "term").join(fitted.scored, "doc_id")
    joint = met.withColumn("joint", F.zip_with("phi", "weights", lambda a, b: a * b))
    return joint.select("doc_id", "word", (F.array_position("joint", F.array_max("joint")) - 1).cast("int").alias("topic"))


def well_separated(scored: DataFrame, least: float = WELL_SEPARATED) -> DataFrame:
    """(doc_id, topic, weight) of documents whose heaviest topic weighs more than ``least``."""
    return dominant_topics(scored.filter(F.array_max("weights") > least))


def with_topics(documents: DataFrame, dominant: DataFrame) -> DataFrame:
    """Documents with topic, cluster, probability and keywords in the metadata."""
    new = dominant.select(
        F.col("doc_id").alias("id"),
        F.create_map(
            F.lit("topic"), F.col("topic").cast("string"), F.lit("cluster"), F.col("topic").cast("string"),
            F.lit("probability"), F.col("weight").cast("string"), F.lit("keywords"), F.col("keywords"),
        ).alias("_new"),
    )
    keys = F.array(*[F.lit(k) for k in ("topic", "cluster", "probability", "keywords")])
    old = F.map_filter("metadata", lambda k, v: ~F.array_contains(keys, k))
    joined = documents.join(new, "id", "left")
    return joined.withColumn("metadata", F.when(F.col("_new").isNotNull(), F.map_concat(old, "_new")).otherwise(F.col("metadata"))).drop("_new")


def document_vectors(lemmas: DataFrame, size: int = 50, min_count: int = 20, clusters: int = 4, seed: int = 42, tokens: str = "lemmas") -> DataFrame:
    """(doc_id, vec, x, y, cluster): averaged word vectors, two principal components, k-means cluster."""
    from textweave.operators.linkage import project

    base = lemmas.select("doc_id", F.col(tokens).alias("tokens"))
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, inputCol="tokens", outputCol="v").fit(base)
    vectors = model.transform(base)
    clustered = KMeans(k=clusters, seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors)
    arrays = clustered.select("doc_id", vector_to_array("v").alias("vec"), "cluster")
    flat = project(arrays.withColumn("xy", F.col("vec")), "xy", 2)
    return flat.select("doc_id", "vec", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"), "cluster")
