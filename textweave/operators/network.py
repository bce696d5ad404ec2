"""Networks of words and of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweave.plans.edits import near_pairs
from textweave.plans.lineage import written


def cooccurrence_edges(lemmas: DataFrame, window: int = 2, tokens: str = "lemmas") -> DataFrame:
    """(source, target, weight): unordered pairs of tokens less than ``window`` positions apart.

    Neighbours are read from the document's own array, so only counted pairs are shuffled.
    """
    if window < 2:
        raise ValueError("a window holds at least two tokens")
    t, n = F.col(tokens), F.size(tokens)

    def at_distance(d: int):
        pair = lambda i: F.struct(F.get(t, i).alias("a"), F.get(t, i + d).alias("b"))
        return F.when(n > d, F.transform(F.sequence(F.lit(0), n - d - 1), pair))

    distances = [F.coalesce(at_distance(d), F.array().cast("array<struct<a:string,b:string>>")) for d in range(1, window)]
    cells = lemmas.select(F.explode(F.concat(*distances)).alias("p"))
    return cells.groupBy(
        F.least("p.a", "p.b").alias("source"), F.greatest("p.a", "p.b").alias("target")
    ).agg(F.count(F.lit(1)).alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbour, weight) from undirected edges, one record per direction; a loop appears once."""
    back = edges.filter(F.col("source") != F.col("target"))
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "weight").unionByName(
        back.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "weight")
    )


def similarity_edges(texts: DataFrame, min_similarity: float = 0.8, text: str = "sentence") -> DataFrame:
    """(source, target, weight): distinct texts whose edit similarity is at least ``min_similarity`` (above 0.5).

    Exact without comparing all pairs: pairs that share a piece where few edits leave it (``near_pairs``) are compared.
    """
    if not 0.5 < min_similarity <= 1:
        raise ValueError("min_similarity must be above 0.5 and at most 1")
    s = F.lit(min_similarity)
    edits = lambda n: F.floor((1 - s) * n + 1e-9).cast("int")
    distinct = written(
        texts.select(F.col(text).alias("t")).distinct().select("t", F.length("t").alias("n"))
        .filter(edits(F.floor(F.col("n") / s + 1e-9)) > 0),  # a shorter text is only similar to itself
        "texts",
    )
    most = f"cast(floor((1 - {float(min_similarity)!r}D) * length(long) + 1e-9D) as int)"
    pairs = near_pairs(distinct, min_similarity)
    # a generated column is worked out once
    compared = pairs.select("short", "long", F.explode(F.array(F.expr(f"levenshtein(short, long, {most})"))).alias("d"))
    return compared.filter(F.col("d") >= 0).select(
        F.least("short", "long").alias("source"), F.greatest("short", "long").alias("target"),
        (1 - F.col("d") / F.length("long")).alias("weight"),
    )
