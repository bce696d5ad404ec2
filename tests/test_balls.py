"""The greedy cover against one point after the other, by batches and by grid rounds."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.operators import ballmapper
from textweave.plans import balls


def expected(rows, radius):
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    landmarks = []
    for i, v in order:
        if all(balls.distances(np.array([v]), np.array([w]))[0, 0] > radius for _, w in landmarks):
            landmarks.append((i, v))
    return [i for i, _ in landmarks], {(f"B{k}", i) for k, (_, w) in enumerate(landmarks) for i, v in rows if balls.distances(np.array([v]), np.array([w]))[0, 0] <= radius}


def cloud(kind):
    rng = np.random.default_rng(4)
    if kind == "ten columns":
        return [(i, v.tolist()) for i, v in enumerate(rng.random((250, 10)))], 0.8
    if kind == "hot cell":
        return [(i, [0.5, 0.5]) for i in range(300)] + [(300 + i, (0.5 + 0.01 * v).tolist()) for i, v in enumerate(rng.random((200, 2)))] + [(600, [0.9, 0.1])], 0.004
    if kind == "many balls":
        return [(i, v.tolist()) for i, v in enumerate(rng.random((300, 3)))], 0.05
    return [(i, [float(v)]) for i, v in enumerate(rng.random(200))], 0.1


@pytest.mark.parametrize("kind", ["ten columns", "hot cell", "many balls", "one column"])
@pytest.mark.parametrize("batch, most", [(20_000, 50_000), (40, 0)])
def test_cover_and_members(spark, kind, batch, most):
    rows, radius = cloud(kind)
    df = spark.createDataFrame([(i, v, float(i)) for i, v in rows], "row_id bigint, vec array<double>, y double").repartition(3)
    landmarks, inside = expected(rows, radius)
    found = ballmapper.cover(df, radius, batch=batch)
    assert [r.landmark_row for r in found.orderBy("ball_no").collect()] == landmarks
    got = [(r.ball_id, r.row_id) for r in ballmapper.membership(df, found, radius, most).collect()]
    assert set(got) == inside and len(got) == len(inside)


def test_no_points(spark):
    df = spark.createDataFrame([], "row_id bigint, vec array<double>, y double")
    empty = ballmapper.cover(df, 0.1)
    assert empty.count() == 0 and ballmapper.membership(df, empty, 0.1).count() == 0


def test_most_points_leave_after_the_first_batch(spark):
    """A batch of 500 of 50,000 random points decides nearly all of them."""
    df = spark.range(50_000).select(F.col("id").alias("row_id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    df = df.cache()
    left = df.withColumn("o", F.md5(F.col("row_id").cast("string")))
    head = balls.greedy(left.orderBy("o").limit(500), 0.1)
    rest = balls.uncovered(left, np.array([r.vec for r in head.collect()]), 0.1)
    assert 0 < rest.count() < 2500
    assert ballmapper.cover(df, 0.1, batch=500).count() == ballmapper.cover(df, 0.1).count()
    df.unpersist()
