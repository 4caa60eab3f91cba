"""Clusters by Drake's bounds against plain Lloyd rounds, edge cases, and how much the bounds save."""

import hashlib
import random

import numpy as np
import pytest

from loomwork.llm import centroid_clustering as cc


def plain(rows, k=16, rounds=3, size=64, scale=64):
    """``rows`` of (id, vector) that take part, as Python's whole numbers; the last centroids and each row's cluster and distance."""
    kept = [(i, [int(x * scale // 1) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and abs(x) < float("inf") for x in v)]
    mark = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=mark)[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, x) in zip(kept, found, strict=True) if x == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return kept, centroids, found


def crowd(n, seed=3, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(24, 64)) / 8
    return [(k, [float(x) for x in middle[k % 24] + rng.normal(size=64) * spread]) for k in range(n)]


def rows_of(found):
    return sorted(((-1 if r["id"] is None else r["id"]), r["cluster"], r["distance"]) for r in found.collect())


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.3])
def test_clusters_equal_plain_rounds(spark, spread):
    rows = crowd(400, spread=spread)
    got, centroids = cc.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    kept, want, found = plain(rows)
    assert centroids.tolist() == want and rows_of(got) == sorted((i, j, d) for (i, _), (d, j) in zip(kept, found, strict=True))


def test_more_rounds_with_fewer_bounds(spark):
    rows = crowd(300, seed=8, spread=0.1)
    got, centroids = cc.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20, rounds=6)
    kept, want, found = plain(rows, k=20, rounds=6)
    assert centroids.tolist() == want and rows_of(got) == sorted((i, j, d) for (i, _), (d, j) in zip(kept, found, strict=True))


def test_bounds_spare_distances(spark):
    got, _ = cc.cluster_vectors(spark.createDataFrame(crowd(2000), "vec_id long, embedding array<double>"), rounds=5)
    assert got.agg({"compared": "avg"}).first()[0] < 4  # of 16


def test_bounds_never_lie():
    """After any moves of the centroids, what the bounds certify is what all distances say, ties included."""
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (500, 4))  # few different distances, many ties
    centroids = rng.integers(-3, 4, (9, 4))
    bounds = cc.Bounds.of(x, centroids, 3)
    for n in range(30):
        new = centroids + rng.integers(-1, 2, centroids.shape) * (rng.random((9, 1)) < 0.3)
        bounds.move(np.sqrt(((new - centroids) ** 2).sum(axis=1)))
        centroids = new
        bounds.settle(x, centroids)
        d = cc.squared_distances(x, centroids)
        assert (bounds.cluster == d.argmin(axis=1)).all()
        own = np.sqrt(np.take_along_axis(d, bounds.cluster[:, None], axis=1)[:, 0])
        assert (bounds.upper >= own - 1e-12).all() and (bounds.lows <= np.sqrt(np.take_along_axis(d, bounds.near, axis=1)) + 1e-12).all()
        if n == 10:
            bounds = bounds.narrowed(2)


def test_odd_vectors(spark):
    good = [0.5, -0.01] + [0.0] * 62
    rows = [(1, good), (1, good), (2, [-x for x in good]), (None, good), (3, None), (4, good[:63]), (5, [float("nan"), *good[1:]]), (6, [None, *good[1:]]), (7, [float("inf"), *good[1:]]), (8, []), (9, good[::-1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'mine' id", "'mine' cluster", "'mine' distance")
    got, centroids = cc.cluster_vectors(df)
    kept, want, found = plain(rows)
    assert len(want) == 5 and centroids.tolist() == want
    assert rows_of(got) == sorted(((-1 if i is None else i), j, d) for (i, _), (d, j) in zip(kept, found, strict=True))
    digest = cc.clusters_digest(df).collect()
    assert {r["inertia"] for r in digest} == {sum(d for d, _ in found)} and len(digest) == 5
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want[r["cluster"]])).encode()).hexdigest() for r in digest)
    assert cc.clusters_digest(df.limit(0)).count() == 0 and cc.clusters_digest(df.where("embedding is null")).count() == 0


def test_huge_components_are_bounded(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([1e30, -1e30, 2e5, 0.0]) for _ in range(64)]) for k in range(40)]
    got, centroids = cc.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    bound = cc.LARGEST / 64
    kept, want, found = plain([(k, [max(-bound, min(bound, x)) for x in v]) for k, v in rows])
    assert centroids.tolist() == want and rows_of(got) == sorted((i, j, d) for (i, _), (d, j) in zip(kept, found, strict=True))
