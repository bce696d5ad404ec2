"""Connected components of a large edge table by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import written


def _flat(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent) with parents below their nodes: pointers are doubled until nothing moves."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        stepped = written(
            parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")),
            "parents",
        )
        parents = stepped.select("node", "parent")
        if stepped.filter("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; the root is the smallest node of its component.

    Each round hangs every remaining node below its smallest neighbour, flattens, and contracts the edges; every
    component shrinks in each round, so the rounds grow with the logarithm of the size. Only emptiness of the edge table
    returns to the driver. Edges with a null end are ignored, loops and repeats do no harm; no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    live = written(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    roots = written(roots, "roots")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        parents = _flat(written(hung, "parents"))
        to = lambda name: parents.select(F.col("node").alias(name), F.col("parent").alias(f"{name}_up"))  # noqa: B023, E731
        contracted = live.join(to("a"), "a").join(to("b"), "b").filter("a_up <> b_up")
        live = written(contracted.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        roots = written(roots.join(to("root"), "root", "left").select("node", F.coalesce("root_up", "root").alias("root")), "roots")
    return roots
