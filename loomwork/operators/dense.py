"""Exact dense retrieval by inner product or squared distance, in blocks.

Queries and vectors are dealt into blocks of bounded size, every block of queries meets every block of vectors in a task
of its own, and hands on its best ``k`` per query. Neither side is collected or broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions.text import let, terms

BLOCK_QUERIES, BLOCK_VECTORS = 1024, 16_384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalize(vector: Column) -> Column:
    """Length one; a zero vector stays."""
    scaled = lambda v: let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n)))
    return let(vector, scaled)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _block(metric: str, k: int):
    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            order = np.argsort(vectors["vec_id"].to_numpy(), kind="stable")
            ids, x, q = vectors["vec_id"].to_numpy()[order], _matrix(vectors["vector"])[order], _matrix(queries["vector"])
            score = q @ x.T if metric == "ip" else -((q**2).sum(axis=1)[:, None] - 2 * q @ x.T + (x**2).sum(axis=1))
            slack = 1e-9 * (1 + np.abs(score).max())
            for n, query in enumerate(queries["query_id"].to_pylist()):
                at = np.arange(len(ids)) if len(ids) <= k else np.flatnonzero(score[n] >= np.partition(score[n], -k)[-k] - slack)
                exact = (x[at] * q[n]).sum(axis=1) if metric == "ip" else ((x[at] - q[n]) ** 2).sum(axis=1)
                top = np.lexsort((ids[at], -exact if metric == "ip" else exact))[:k]
                out[0] += [query] * len(top)
                out[1] += ids[at[top]].tolist()
                out[2] += exact[top].tolist()
        return pa.table([pa.array(out[0], queries.schema.field("query_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return best


def search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", query_id: str = "query_id", query_vector: str = "vector", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product (``ip``) or least squared distance (``l2``).

    Ties go to the smaller id. Null vectors take no part. All vectors must have one size.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")).where("vector is not null")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vector is not null")
    n_q, n_v = (max(1, math.ceil(df.count() / size)) for df, size in ((q, BLOCK_QUERIES), (v, BLOCK_VECTORS)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = q.select("query_id", "vector", own("query_id", n_q).alias("qb"), spread(n_v).alias("vb"))
    v = v.select("vec_id", "vector", spread(n_q).alias("qb"), own("vec_id", n_v).alias("vb"))
    kind = q.schema["query_id"].dataType.simpleString()
    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(_block(metric, k), f"query_id {kind}, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score") if metric == "ip" else F.asc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def with_prefix(text: Column, model: str, prefix: str) -> Column:
    """Models of some families want a prefix before passages and queries; others don't."""
    return F.concat(F.lit(prefix), text) if "bge" in model.lower() else text


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a trained encoder: signed counts of hashed terms, of length one.

    Where these cancel out, plain counts stand in for them: only a text without a term has the zero vector.
    """

    def counts(hashes: Column, weight) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + weight(h)))

    def vector(hashes: Column) -> Column:
        signed = counts(hashes, lambda h: F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0))
        return let(signed, lambda v: F.when(F.exists(v, lambda x: x != 0), v).otherwise(counts(hashes, lambda h: F.lit(1.0))))

    return normalize(let(F.transform(terms(text), lambda t: F.xxhash64(t)), vector))


def embed(df: DataFrame, encoder=None, text_col: str = "text", into: str = "embedding") -> DataFrame:
    """``df`` with unit vectors of its texts. ``encoder`` maps a text column to a vector column (an iterator UDF, say).

    A null or blank text is an error, as is one without any encoder's answer.
    """
    checked = F.when(F.trim(F.coalesce(F.col(text_col), F.lit(""))) == "", F.raise_error(F.lit("a text to embed is empty"))).otherwise(F.col(text_col))
    vector = (encoder or hashed_embedding)(checked)
    return df.withColumn(into, F.transform(normalize(vector), lambda x: x.cast("float")))
