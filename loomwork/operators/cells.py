"""Exact dense retrieval with bounds: cells of vectors that can't hold one of a query's best are never read.

Vectors are assigned to the nearest of some centres; a cell has a centre and a radius, within which all of its vectors
lie. From a query's distance to the centre follows the best score that any of the cell's vectors can have. A first pass
looks into each query's most promising cells, as many as hold ``k`` vectors; its k-th score rules out most other cells,
and a second pass looks into what is left. The result is that of comparing with everything.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators.dense import BLOCK_QUERIES, BLOCK_VECTORS, _block
from loomwork.operators.windows import shared_folder

#: Centres grow with the root of the vectors up to so many, which every task can hold; beyond it cells grow, and are cut into parts.
MOST_CELLS = 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)))


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = _matrix(part.column("vector"), centres.shape[1])
                cell = _distances(x, centres).argmin(axis=1)
                apart = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), pa.array(cell.astype(np.int32)), pa.array(apart)], names=["vec_id", "vector", "cell", "apart"])

    return run


@dataclass
class CellIndex:
    """``vectors`` (vec_id, vector, cell, apart), and for each cell its centre, radius and number of vectors."""

    vectors: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, path: str | None = None) -> CellIndex:
        """The index of all vectors that aren't null; centres are a sample by the hash of the id, at most ``MOST_CELLS``."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vector is not null")
        cells = cells or min(MOST_CELLS, math.ceil(math.sqrt(rows.count())))
        drawn = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, cells)).select("vector").collect()], dtype=np.float64)
        centres = np.unique(drawn, axis=0) if len(drawn) else np.zeros((0, 0))
        path = path or f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
        kind = rows.schema["vector"].dataType.simpleString()
        placed = rows.mapInArrow(_assign(centres), f"vec_id long, vector {kind}, cell int, apart double") if len(centres) else rows.limit(0).selectExpr("*", "0 cell", "0D apart")
        placed.write.mode("overwrite").parquet(path)
        placed = spark.read.parquet(path)
        radius, count = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
        for r in placed.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():  # a row for each centre
            radius[r["cell"]], count[r["cell"]] = r["radius"] * (1 + 1e-9), r["n"]
        return cls(placed, centres, radius, count)

    def bounds(self, q: np.ndarray, metric: str) -> np.ndarray:
        """The best score that a vector of each cell can have for each query; empty cells have none."""
        if metric == "ip":
            best = q @ self.centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * self.radius
        else:
            best = -(np.maximum(0.0, _distances(q, self.centres) - self.radius - 1e-7) ** 2)
        return np.where(self.count > 0, best + 1e-9 * (1 + np.abs(best)), -np.inf)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """For each query, whether each cell is among the most promising ones that together hold ``k`` vectors."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        chosen = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen & (self.count > 0)


def _ask(held, metric: str, k: int, again: bool):
    """Rows of queries and the cells that they look into: the first ones, or (``again``) others that may beat the k-th score ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for n in range(0, batch.num_rows, 256):
                part = batch.slice(n, 256)
                bounds = index.bounds(_matrix(part.column("vector"), index.centres.shape[1]), metric)
                chosen = index.first(bounds, k)
                if again:
                    least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    chosen = ~chosen & (index.count > 0) & (bounds >= np.where(np.isnan(least), -np.inf, least)[:, None])
                row, cell = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), part.column("vector").take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["query_id", "vector", "cell"])

    return run


def _look(asked: DataFrame, index: CellIndex, metric: str, k: int, n_queries: int) -> DataFrame:
    """The best ``k`` of each query in each cell that it asks for. Only cells that are asked for leave their files."""
    spark = asked.sparkSession
    blocks = max(1, math.ceil(n_queries / BLOCK_QUERIES))
    parts = F.get(F.lit([int(max(1, math.ceil(n / BLOCK_VECTORS))) for n in index.count]).cast("array<int>"), F.col("cell"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked.write.parquet(path := f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}")
    asked = spark.read.parquet(path)
    wanted = asked.select("cell", F.col("qb").alias("block")).distinct()
    vectors = index.vectors.join(wanted, "cell").select("vec_id", "vector", "cell", F.col("block").alias("qb"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"))
    queries = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    kind = asked.schema["query_id"].dataType.simpleString()
    keys = ("cell", "part", "qb")
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(_block(metric, k), f"query_id {kind}, vec_id long, score double")


def search(queries: DataFrame, index: CellIndex, k: int, metric: str = "ip", query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score``: the same rows as ``dense.search`` gives. Null vectors take no part; all must have one size."""
    hits, _ = search_with_share(queries, index, k, metric, query_id, query_vector)
    return hits


def search_with_share(queries: DataFrame, index: CellIndex, k: int, metric: str = "ip", query_id: str = "query_id", query_vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """The hits, and for each query the share of all vectors that lie in cells it looked into: ``query_id, share``."""
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")).where("vector is not null")
    kind, vector = (q.schema[c].dataType.simpleString() for c in ("query_id", "vector"))
    if not len(index.centres):
        return (spark.createDataFrame([], f"query_id {kind}, {rest}") for rest in ("rank int, vec_id long, score double", "share double"))
    held, n = spark.sparkContext.broadcast(CellIndex(None, index.centres, index.radius, index.count)), q.count()
    schema = f"query_id {kind}, vector {vector}, cell int"
    asked = q.mapInArrow(_ask(held, metric, k, False), schema)
    order = W.partitionBy("query_id").orderBy(F.desc("kept"), "vec_id")
    ranked = lambda df: df.withColumn("kept", F.col("score") if metric == "ip" else -F.col("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked(_look(asked, index, metric, k, n)).write.parquet(path := f"{shared_folder(spark)}/first-{uuid.uuid4().hex}")
    first = spark.read.parquet(path)
    least = first.where(F.col("rank") == k).select("query_id", F.col("kept").alias("least"))
    more = q.join(least, "query_id", "left").mapInArrow(_ask(held, metric, k, True), schema)
    found = first.select("query_id", "vec_id", "score").union(_look(more, index, metric, k, n))
    sizes = F.get(F.lit(index.count.tolist()).cast("array<long>"), F.col("cell"))
    share = asked.union(more).groupBy("query_id").agg((F.sum(sizes) / float(index.count.sum())).alias("share"))
    return ranked(found).select("query_id", "rank", "vec_id", "score"), share
