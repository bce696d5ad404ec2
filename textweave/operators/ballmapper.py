"""Ball mapper: covering a point cloud with balls of one radius, and how the balls overlap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.functions.vectors import euclidean_distance
from textweave.operators.features import min_max
from textweave.operators.linkage import project
from textweave.plans.balls import greedy, members, uncovered
from textweave.plans.lineage import cut_lineage
from textweave.plans.ordering import with_dense_index

BATCH = 20_000  # undecided points that one task decides
BALLS_HELD = 50_000  # landmarks that every task holds
PER_CELL = 64  # candidates of a grid cell that a round looks at
GRID_DIMENSIONS = 3
LANDMARKS = "ball_id string, ball_no int, landmark_row bigint, location array<double>"


def validate(df: DataFrame, y: str, xs: Sequence[str]) -> None:
    """y must be numeric with other than two values, every x numeric."""
    fields = {f.name: f.dataType for f in df.schema}
    for c in (y, *xs):
        if c not in fields:
            raise ValueError(f"no column {c!r}")
        if not isinstance(fields[c], T.NumericType):
            raise ValueError(f"column {c!r} is not numeric")
    if df.select(y).filter(F.col(y).isNotNull()).distinct().limit(3).count() == 2:
        raise ValueError(f"column {y!r} has two values only; a continuous one is needed")


def point_cloud(df: DataFrame, y: str, xs: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, vec, y): complete records, every variable scaled to [0, 1]."""
    used = list(dict.fromkeys([y, *xs]))
    complete = df.select(F.col(row_id).alias("_row"), *used).dropna("any")
    scaled = min_max(complete, used)
    return scaled.select(F.col("_row").alias("row_id"), F.array(*xs).alias("vec"), F.col(y).alias("y"))


def default_order() -> Column:
    return F.md5(F.col("row_id").cast("string"))


def cover(points: DataFrame, radius: float, order: Column | None = None, per_cell: int = PER_CELL, batch: int = BATCH) -> DataFrame:
    """Landmarks of the greedy cover: in a fixed order, a point no earlier ball holds becomes a landmark.

    The first ``batch`` undecided points are decided in one task, and all points that their landmarks hold leave. As the
    order is like a random one, few points stay unless there are very many balls. When such a step clears less than half,
    the rest is decided in rounds over all grid cells (``_cell_rounds``). Both give the same landmarks. Each step writes
    what is left; only its size and at most ``batch`` landmarks reach the driver.
    """
    rank = default_order() if order is None else order
    left = cut_lineage(points.select("row_id", F.col("vec").cast("array<double>").alias("vec"), F.struct(rank.alias("o"), F.col("row_id").alias("r")).alias("_order")))
    found: list[DataFrame] = []
    size = left.count()
    while size:
        new = cut_lineage(greedy(left.orderBy("_order").limit(batch), radius))
        found.append(new)
        if size <= batch:
            break
        left = cut_lineage(uncovered(left, np.array([r["vec"] for r in new.select("vec").collect()]), radius))
        before, size = size, left.count()
        if size > before / 2:
            found += _cell_rounds(left, radius, per_cell)
            break
    if not found:
        return points.sparkSession.createDataFrame([], LANDMARKS)
    numbered = with_dense_index(reduce(DataFrame.unionByName, found).withColumns({"_o": F.col("_order.o")}), ["_o", "row_id"], "ball_no")
    return numbered.select(
        F.concat(F.lit("B"), F.col("ball_no").cast("string")).alias("ball_id"), F.col("ball_no").cast("int").alias("ball_no"),
        F.col("row_id").alias("landmark_row"), F.col("vec").alias("location"),
    )


def _cell_rounds(left: DataFrame, radius: float, per_cell: int) -> list[DataFrame]:
    """Landmarks among ``left(row_id, vec, _order)``, in parallel over the grid.

    The candidates of a round are the first ``per_cell`` undecided points of each grid cell, one for each fine cell (whose
    points all hold each other). A candidate with no earlier undecided point within the radius is a landmark of the greedy
    order; the points its ball holds are decided too. The first undecided point always becomes a landmark.
    """
    d = left.select(F.size("vec").alias("d")).first()["d"]
    g = min(d, GRID_DIMENSIONS)
    fine = radius / d**0.5 * (1 - 1e-9)
    left = cut_lineage(left.withColumns({"cell": _cell(F.col("vec"), radius, g), "fine": _cell(F.col("vec"), fine, d)}))
    found: list[DataFrame] = []

    def near(some: DataFrame, hit: Column, what: str) -> DataFrame:
        """Column ``what`` of the pairs of an undecided point and one of ``some`` within the radius for which ``hit``."""
        around = _around(some.select(F.col("row_id").alias("_row"), F.col("vec").alias("_vec"), F.col("_order").alias("_theirs")), "_vec", radius, g)
        pairs = left.join(around, "cell").filter(hit & (euclidean_distance("vec", "_vec") <= radius))
        return pairs.select(F.col(what).alias("row_id")).distinct()

    while not left.isEmpty():
        heads = left.groupBy("cell", "fine").agg(F.min_by(F.struct("row_id", "vec", "_order"), "_order").alias("h")).select("cell", "h.*")
        early = Window.partitionBy("cell").orderBy("_order")
        candidates = cut_lineage(heads.withColumn("_n", F.row_number().over(early)).filter(F.col("_n") <= per_cell).drop("_n"))
        blocked = near(candidates, F.col("_order") < F.col("_theirs"), "_row")
        new = cut_lineage(candidates.join(blocked, "row_id", "left_anti").select("row_id", "vec", "_order"))
        found.append(new)
        held = near(new, F.lit(True), "row_id")
        left = cut_lineage(left.join(held, "row_id", "left_anti"))
    return found


def _cell(vector: Column, radius: float, dimensions: int) -> Column:
    return F.array(*[F.floor(F.get(vector, F.lit(i)) / radius).cast("bigint") for i in range(dimensions)])


def _around(some: DataFrame, vector: str, radius: float, dimensions: int) -> DataFrame:
    """Each record once for every grid cell around that of its ``vector``, as ``cell``."""
    shifts = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in shift]) for shift in product((-1, 0, 1), repeat=dimensions)])
    placed = some.withColumns({"_home": _cell(F.col(vector), radius, dimensions), "_shift": F.explode(shifts)})
    return placed.withColumn("cell", F.zip_with("_home", "_shift", lambda a, b: a + b)).drop("_home", "_shift")


def membership(points: DataFrame, landmarks: DataFrame, radius: float, most: int = BALLS_HELD) -> DataFrame:
    """(ball_id, row_id, y) of the points within the radius of each landmark.

    Up to ``most`` landmarks every task holds them and points stay where they are; beyond that landmarks are entered in the
    grid cells around theirs, so each point meets only near ones.
    """
    few = landmarks.select("ball_id", F.col("location").cast("array<double>").alias("location")).limit(most + 1).collect()
    if len(few) <= most:
        ready = points.select("row_id", "y", F.col("vec").cast("array<double>").alias("vec"))
        return members(ready, [r["ball_id"] for r in few], np.array([r["location"] for r in few]), radius)
    g = min(len(few[0]["location"]), GRID_DIMENSIONS)
    near = _around(landmarks.select("ball_id", "location"), "location", radius, g)
    placed = points.withColumn("cell", _cell(F.col("vec"), radius, g))
    return placed.join(near, "cell").filter(euclidean_distance("vec", "location") <= radius).select("ball_id", "row_id", "y")


def ball_statistics(landmarks: DataFrame, members: DataFrame) -> DataFrame:
    """(ball_id, ball_no, landmark_row, location, n, mean_y)."""
    stats = members.groupBy("ball_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))
    return landmarks.join(stats, "ball_id")


def connections(members: DataFrame) -> DataFrame:
    """(a, b): balls that share a point, a before b by name.

    The balls of one point are few; points with the same balls count once before pairs are made.
    """
    sets = members.groupBy("row_id").agg(F.array_sort(F.collect_set("ball_id")).alias("balls")).filter(F.size("balls") > 1)
    distinct = sets.select("balls").distinct().select("balls", F.posexplode("balls").alias("i", "a"))
    later = F.slice("balls", F.col("i") + 2, F.size("balls"))
    return distinct.select("a", F.explode(later).alias("b")).distinct()


def connection_lists(edges: DataFrame) -> DataFrame:
    """(ball_id, other): symmetric connections as records."""
    return edges.select(F.col("a").alias("ball_id"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("ball_id"), F.col("a").alias("other"))
    )


@dataclass(frozen=True)
class BallMap:
    points: DataFrame
    landmarks: DataFrame
    members: DataFrame
    balls: DataFrame
    edges: DataFrame


def ball_map(df: DataFrame, y: str, xs: Sequence[str], radius: float = 0.3, row_id: str = "row_id", order: Column | None = None) -> BallMap:
    validate(df, y, xs)
    points = point_cloud(df, y, xs, row_id)
    landmarks = cut_lineage(cover(points, radius, order))
    inside = membership(points, landmarks, radius)
    return BallMap(points, landmarks, inside, ball_statistics(landmarks, inside), connections(inside))


def layout(balls: DataFrame) -> DataFrame:
    """(ball_id, x, y, colour, size): two principal components of the locations, mean_y to 0..1, counts to 100..2000."""
    padded = F.when(F.size("location") < 2, F.concat("location", F.array(F.lit(0.0)))).otherwise(F.col("location"))
    flat = project(balls.withColumn("xy", padded), "xy", 2)
    s = balls.agg(F.min("mean_y"), F.max("mean_y"), F.min("n"), F.max("n")).first()
    colour = F.lit(0.5) if s[0] == s[1] else (F.col("mean_y") - s[0]) / (s[1] - s[0])
    size = F.lit(500.0) if s[2] == s[3] else 100 + 1900 * (F.col("n") - s[2]) / (s[3] - s[2])
    return flat.select("ball_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"), colour.alias("colour"), size.alias("size"))
