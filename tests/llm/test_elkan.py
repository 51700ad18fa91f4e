"""Clusters against plain code, their SQL, and what bounds and odd vectors do."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import elkan, queries
from tests.oracle import SMALL, connection, differences


def plain_clusters(rows, k, rounds, scale=1024, seed=3):
    """All distances, by Python's integers."""
    kept = [(i, [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v]) for i, v in rows]
    hashed = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for *_, v in hashed[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        for j in range(len(centroids) if turn < rounds else 0):
            own = [v for (_, v), (_, n) in zip(kept, near) if n == j]
            centroids[j] = [sum(c) // len(own) for c in zip(*own)] if own else centroids[j]
    return sorted((str(i), j, d if d < 1 << 63 else None, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near))


def found(frame):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["centroid_sha256"]) for r in frame.collect())


def test_whole_table_by_sql(spark):
    assert not differences(queries.op12_elkan(spark, SMALL), connection(), queries.clusters_sql())


@pytest.mark.parametrize("dims", [1, 3])
def test_ties_and_repeats(spark, dims):
    """Small whole numbers: many equal distances, vectors and empty clusters."""
    draw = random.Random(dims)
    rows = [(i, [float(draw.randrange(-3, 4)) for _ in range(dims)]) for i in range(120)] + [(5, [1.0] * dims), (None, [2.0] * dims), (None, [2.0] * dims)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(elkan.elkan_clusters(frame, k=8, rounds=6, dims=dims, scale=1)) == plain_clusters(rows, 8, 6, scale=1)


def test_large_components_are_exact(spark):
    rows = [(i, [3e38 if i % 3 == 0 else float(i), -2.5e30 * i, 1e17 + i]) for i in range(30)]
    result = elkan.elkan_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, rounds=3, dims=3)
    assert found(result) == plain_clusters(rows, 4, 3)
    assert result.filter("distance is null").count() and not result.filter("inertia is not null").count()


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [], 1), (8, [0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").withColumn("ids", F.lit("x"))
    result = elkan.elkan_clusters(frame, dims=2)
    assert {(r["vec_id"], r["distance"], r["inertia"]) for r in result.collect()} == {(1, 0, 0), (8, 0, 0)}
    empty = elkan.elkan_clusters(frame.filter("false"), dims=2)
    assert empty.columns == result.columns and empty.count() == 0


def test_bounds_leave_distances_out():
    draw = np.random.default_rng(1)
    centroids = draw.integers(-3000, 3000, (8, 64))
    x = np.concatenate([c + draw.integers(-200, 200, (100, 64)) for c in centroids])
    near, upper, lower = np.zeros(800, np.int32), np.full(800, np.inf), np.zeros((800, 8))
    elkan.assign(x, near, upper, lower, centroids, np.zeros(8))
    again = centroids + 1
    made = elkan.assign(x, near, upper, lower, again, np.full(8, 8.001))
    exact = ((x[:, None, :] - again[None]) ** 2).sum(axis=2)
    assert made < 800 and (near == exact.argmin(axis=1)).all()
    assert (upper >= np.sqrt(exact[np.arange(800), near])).all() and (lower <= np.sqrt(exact)).all()
