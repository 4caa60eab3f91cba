"""Exact k-means over integer vectors with Drake's adaptive bounds.

Beside its centroid and an upper bound of the distance to it, every vector keeps lower bounds of its distances to the few
next centroids, nearest first, and one more for all the rest. When centroids have moved, the bounds give way by as much. As
long as the upper bound lies below all others, the assignment is certified and nothing is computed; else the distance to
the own centroid is, then those of as many of the stored centroids as may come before it, and only if the remainder bound
can't be passed over, of all centroids. A round that needs fewer stored bounds makes the next one store fewer.

The state of all vectors is a table, written once a round; a task works on what it reads, with the centroids (their number
times the components, whatever the rows) at hand. New centroids come from sums that tasks make of their own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import shared_folder, without

#: Components lie in this range (beyond it they count as its end), so that a squared distance fits 64 bits.
LARGEST = 1 << 27
#: Up to here a product of matrices is exact in double precision.
_EXACT = 1 << 20
#: Bounds give way by this share too, which covers the rounding of roots and sums.
_SLACK = 1e-9
_STATE = "id long, vector array<int>, cluster int, upper double, near array<int>, lows array<double>, rest double, compared int"


def kept_vectors(df: DataFrame, size: int, scale: int, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``id, vector`` of the rows whose vector has exactly ``size`` components, none null or not finite; ``vector`` holds floor(scale * x) of each."""
    v = F.col(vector_col)
    whole = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    places = F.transform(v, lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    return df.where(v.isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), places.alias("vector"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed`` and id; a null id counts as empty text, ties go by the vector."""
    mark = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(mark, "vector").limit(k).select("vector").collect()
    return np.array([r["vector"] for r in found], dtype=np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c**2).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _own_distance(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(axis=1)


def _above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + _SLACK)


def _below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - _SLACK)


@dataclass
class Bounds:
    """The state of some vectors: ``near`` has the stored centroids of each, ``lows`` their lower bounds, which never fall from left to right or to ``rest``."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lows: np.ndarray
    rest: np.ndarray
    compared: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, centroids: np.ndarray, stored: int) -> Bounds:
        """The state after comparing with all centroids."""
        out = cls(*(np.zeros((len(x), stored) if n in (2, 3) else len(x), dtype=t) for n, t in enumerate((np.int32, np.float64, np.int32, np.float64, np.float64, np.int32))))
        out.rescan(np.arange(len(x)), x, centroids)
        return out

    def rescan(self, at: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> None:
        if not len(at):
            return
        d, stored = squared_distances(x[at], centroids), self.near.shape[1]
        order = np.argsort(d, axis=1, kind="stable")  # ties to the smaller number
        d = np.take_along_axis(d, order, axis=1)
        self.cluster[at], self.upper[at] = order[:, 0], _above(d[:, 0])
        self.near[at], self.lows[at] = order[:, 1 : stored + 1], _below(d[:, 1 : stored + 1])
        self.rest[at] = _below(d[:, stored + 1]) if d.shape[1] > stored + 1 else np.inf
        self.compared[at] = d.shape[1]

    def move(self, drift: np.ndarray) -> None:
        """Bounds give way by what the centroids have moved."""
        drift = drift * (1 + _SLACK)
        self.upper = self.upper * (1 + _SLACK) + drift[self.cluster]
        self.rest = self.rest * (1 - _SLACK) - drift.max(initial=0)
        self.lows = self.lows * (1 - _SLACK) - drift[self.near]
        edge = self.rest
        for z in range(self.lows.shape[1] - 1, -1, -1):
            edge = self.lows[:, z] = np.minimum(self.lows[:, z], edge)

    def settle(self, x: np.ndarray, centroids: np.ndarray) -> None:
        """The nearest centroid of each vector, by the bounds where they tell and by distances where they don't."""
        first = lambda: np.minimum(self.lows.min(axis=1, initial=np.inf), self.rest)
        self.compared[:] = 0
        open_ = np.flatnonzero(self.upper >= first())
        self.upper[open_] = _above(_own_distance(x[open_], centroids, self.cluster[open_]))
        self.compared[open_] = 1
        open_ = open_[self.upper[open_] >= first()[open_]]
        whole = self.upper[open_] >= self.rest[open_]
        self.rescan(open_[whole], x, centroids)
        open_ = open_[~whole]
        reach = (self.lows[open_] <= self.upper[open_, None]).sum(axis=1)  # as many stored ones may come before
        for z in np.unique(reach):
            at = open_[reach == z]
            among = np.concatenate([self.cluster[at, None], self.near[at, :z]], axis=1)
            d = ((x[at, None] - centroids[among]) ** 2).sum(axis=2)
            order = np.lexsort((among, d), axis=1)
            d, among = np.take_along_axis(d, order, axis=1), np.take_along_axis(among, order, axis=1)
            self.cluster[at], self.upper[at] = among[:, 0], _above(d[:, 0])
            self.near[at, :z], self.lows[at, :z] = among[:, 1:], _below(d[:, 1:])
            self.compared[at] += z
            edge = self.rest[at]
            for c in range(self.lows.shape[1] - 1, -1, -1):
                edge = np.minimum(self.lows[at, c], edge)
                self.lows[at, c] = edge

    def narrowed(self, stored: int) -> Bounds:
        """As many bounds alone; the remainder bound takes in those that go."""
        rest = np.minimum(self.rest, self.lows[:, stored:].min(axis=1, initial=np.inf))
        return Bounds(self.cluster, self.upper, self.near[:, :stored], self.lows[:, :stored], rest, self.compared)


def _rows(batch: pa.RecordBatch, column: str, dtype, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, width)


def _batch(part: pa.RecordBatch, b: Bounds) -> pa.RecordBatch:
    ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * b.near.shape[1])
    near, lows = pa.ListArray.from_arrays(ends, pa.array(b.near.ravel())), pa.ListArray.from_arrays(ends, pa.array(b.lows.ravel()))
    columns = [part.column("id"), part.column("vector"), pa.array(b.cluster), pa.array(b.upper), near, lows, pa.array(b.rest), pa.array(b.compared)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "vector", "cluster", "upper", "near", "lows", "rest", "compared"])


def _parts(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, size) for k in range(0, batch.num_rows, size))


def _begin(centroids: np.ndarray, stored: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = _rows(part, "vector", np.int64, centroids.shape[1])
            yield _batch(part, Bounds.of(x, centroids, stored))

    return run


def _go_on(before: np.ndarray, centroids: np.ndarray, held: int, stored: int):
    drift = np.sqrt(((before - centroids) ** 2).sum(axis=1).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = _rows(part, "vector", np.int64, centroids.shape[1])
            column = lambda c: part.column(c).to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
            bounds = Bounds(column("cluster"), column("upper"), _rows(part, "near", np.int32, held), _rows(part, "lows", np.float64, held), column("rest"), column("compared"))
            bounds = bounds.narrowed(stored)
            bounds.move(drift)
            bounds.settle(x, centroids)
            yield _batch(part, bounds)

    return run


def _sums(size: int, k: int):
    """What a task's rows add to each cluster: its rows and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for part in _parts(batches):
            x, cluster = _rows(part, "vector", np.int64, size), part.column("cluster").to_numpy()
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * size), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), sums], names=["cluster", "n", "sums"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; empty clusters keep their centroid. What reaches the driver is a number for each cluster and component."""
    k, size = centroids.shape
    parts = state.select("cluster", "vector").mapInArrow(_sums(size, k), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    found = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1:", vector_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """The last assignment of every vector that takes part (``id, vector, cluster, distance, compared``), and the centroids.

    Vectors that are null, of another size, or hold null or non-finite components take no part. Components count as the
    integers floor(scale * x); those beyond ``LARGEST`` as that bound. Equal distances go to the smaller centroid. With
    fewer than ``k`` vectors there are as many centroids as vectors; repeated rows count as often as they occur, a null
    id is an id like any other. ``compared`` is how many distances the last assignment took. An empty table gives no row
    and no centroid; other columns are ignored.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"

    def stored(state: DataFrame, name: str) -> DataFrame:
        state.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = stored(kept_vectors(df, size, scale, vector_col, id_col), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id long, vector array<int>, cluster int, distance long, compared int"), np.zeros((0, size), dtype=np.int64)
    bounds = min(max(1, k // 4), len(centroids) - 1)
    state = stored(rows.mapInArrow(_begin(centroids, bounds), _STATE), "0")
    for n in range(1, rounds + 1):
        before, centroids = centroids, moved(state, centroids)
        held = bounds
        if n > 1:  # stored bounds that no vector needed, short of a rescan, are dropped
            needed = state.where(F.col("compared") < len(centroids)).agg(F.max("compared")).first()[0]
            bounds = max(min(held, (needed or 1) - 1), min(held, max(1, k // 8)))
        state = stored(state.mapInArrow(_go_on(before, centroids, held, bounds), _STATE), str(n))
    own = F.get(F.lit(centroids.tolist()).cast("array<array<long>>"), F.col("cluster"))
    apart = F.aggregate(F.zip_with("vector", own, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, b: a + b)
    return state.select("id", "vector", "cluster", apart.alias("distance"), "compared"), centroids


def clusters_digest(embeddings: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that takes part."""
    found, centroids = cluster_vectors(without(embeddings.select("vec_id", "embedding"), "id"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(total.alias("s")).collect()}  # one row for each centroid
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("cluster"))
    text = [",".join(map(str, c)) for c in centroids.tolist()] or [""]
    inertia = [sums.get(k, 0) for k in range(max(1, len(centroids)))]
    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        F.sha2(of(text, "string"), 256).alias("centroid_sha256"),
    )
