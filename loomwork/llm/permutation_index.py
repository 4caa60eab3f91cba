"""Approximate nearest neighbours, by largest inner product, with a permutation index.

Every vector is represented by the order in which it sees a set of pivots, nearest first. It is posted in the inverted
files of its first few pivots; a query looks into the files of its first many. There, candidates are ranked by the
footrule distance between the two orders, the better ones are reranked by the exact inner product, and each file hands on
a query's best few. The distance is Fagin's for partial orders: a pivot that only one of the two has counts as if the
other had it at the place ``location``, so that the distance falls by ``location`` less the later place for each pivot
that both have.

An inverted file is cut into cells of bounded numbers of vectors and of queries, so that a pivot near which a third of
all vectors lie makes more cells, not larger ones. A candidate that several files hold is looked at in the first of the
query's files only. Vectors go with their posts: a query reranks a few hundredths of all vectors where these have no
structure, and pairs of a query and a candidate would be many more rows than posts.

Inner products are made comparable with distances by one further component that brings all vectors to the length of the
longest, and is 0 for queries. A shorter vector counts as if zeros followed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.llm.shared import cut, mix, small_batches


@dataclass(frozen=True)
class Settings:
    """``pivots`` grow with ``by_root`` times the square root of the vectors between the two bounds (half of the vectors at most).

    ``stored`` pivots of each vector's order are kept, of a query's order ``location`` (or ``probed``, if more); a vector is
    posted under its first ``posted``, and a query looks under its first ``probed``. Of what a query finds in a cell the
    share ``reranked``, but ``at_least`` so many, is reranked.
    """

    least_pivots: int = 256
    most_pivots: int = 16_384
    by_root: float = 26.0
    stored: int = 64
    location: int = 192
    posted: int = 12
    probed: int = 192
    reranked: float = 0.5
    at_least: int = 50
    cell_vectors: int = 4096
    cell_queries: int = 1024


def usable(df: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """``vec_id, vector, norm`` of the vectors that take part: not null, with finite components only, and not all zero."""
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(v.isNotNull() & F.col(id_col).isNotNull())
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double")))
    norm = F.transform(F.array(largest), lambda m: m * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x.cast("double") / m) * (x.cast("double") / m))))[0]
    return rows.withColumn("norm", norm)


class _Pivots:
    """The pivots, all vectors divided by the longest one's length."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.longest = longest
        self.base = vectors / longest
        self.rest = np.sqrt(np.maximum(0.0, 1 - (self.base**2).sum(axis=1)))

    def orders(self, vectors: np.ndarray, stored: int, query: bool) -> np.ndarray:
        """The first pivots that each vector sees, nearest first; ties to the earlier pivot."""
        vectors, width = vectors / self.longest, min(vectors.shape[1], self.base.shape[1])
        far = -(vectors[:, :width] @ self.base[:, :width].T)
        if not query:
            far -= np.sqrt(np.maximum(0.0, 1 - (vectors**2).sum(axis=1)))[:, None] * self.rest
        if stored < far.shape[1]:
            first = np.sort(np.argpartition(far, stored, axis=1)[:, :stored], axis=1)
            far = np.take_along_axis(far, first, axis=1)
        else:
            first = np.broadcast_to(np.arange(far.shape[1]), far.shape)
        return np.take_along_axis(first, np.argsort(far, axis=1, kind="stable"), axis=1).astype(np.int16)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows, in double precision; zeros follow the shorter ones."""
    size, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _post(held, s: Settings, query: bool, files: int):
    """Rows of the inverted files: the pivot and its place in the vector's order, the order, and the vector."""
    kept = max(s.location, files) if query else max(s.stored, files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                order = held.value.orders(_matrix(part.column("vector")), kept, query)
                places = min(files, order.shape[1])
                take = pa.array(np.repeat(np.arange(part.num_rows), places))
                columns = [
                    pa.array(order[:, :places].ravel().astype(np.int32)),
                    part.column("vec_id").take(take),
                    pa.array([x[: s.location if query else s.stored].tobytes() for x in order], pa.binary()).take(take),
                    part.column("vector").take(take),
                    pa.array(np.tile(np.arange(places, dtype=np.int32), part.num_rows)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["pivot", "vec_id", "order", "vector", "place"])

    return run


def _first_rows(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of rows in order of their ids, those that don't repeat the id and vector of the row before."""
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
    return np.flatnonzero(new)


def _search_cell(s: Settings, pivots: int, k: int, whole: bool):
    """The best ``k`` of one cell's vectors for each of its queries.

    If the queries look into all files (``whole``), each vector counts in the file of its first pivot, and none is left out.
    """

    def search(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, query_ids = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(query_ids):
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            x = _matrix(vectors["vector"].combine_chunks().take(pa.array(by_id)))
            q = _matrix(queries["vector"].combine_chunks())
            width = min(x.shape[1], q.shape[1])
            orders = np.frombuffer(b"".join(vectors["order"].to_pylist()), dtype=np.int16).reshape(len(ids), -1)[by_id]
            once = _first_rows(ids, x)
            ids, x, orders = ids[once], x[once], orders[once]
            asked = np.frombuffer(b"".join(queries["order"].to_pylist()), dtype=np.int16).reshape(len(query_ids), -1)
            at, here = queries["place"].to_numpy(), np.arange(orders.shape[1])
            own = np.argsort(query_ids, kind="stable")
            for n in own[_first_rows(query_ids[own], q[own])].tolist():
                place = np.full(pivots, s.location, dtype=np.int32)  # of each pivot in the query's order
                place[asked[n]] = np.arange(asked.shape[1])
                mine = ids != query_ids[n]
                mine &= orders[:, 0] == key[0].as_py() if whole else place[orders[:, : s.posted]].min(axis=1) >= at[n]
                found = np.flatnonzero(mine)
                most = max(s.at_least, math.ceil(s.reranked * len(found)))
                if len(found) > most and not whole:
                    shared = np.maximum(0, s.location - np.maximum(place[orders[found]], here)).sum(axis=1)
                    found = found[np.sort(np.argsort(-shared, kind="stable")[:most])]  # ties to the smaller id
                score = (x[found, :width] * q[n, :width]).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), query_ids[n]), ids[found[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return search


def _split(posts: DataFrame, counts: DataFrame, own: str, other: str) -> DataFrame:
    """Posts with their cell: ``own`` is drawn by the row's id, and the row goes to each of the ``other`` cells."""
    joined = posts.join(F.broadcast(counts), "pivot")  # a row for each pivot, at most ``most_pivots``
    draw = F.pmod(F.xxhash64("vec_id"), F.col(f"n_{own}")).cast("int").alias(own)
    return joined.select("pivot", "vec_id", "order", "vector", "place", draw, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other))


def _search(vectors: DataFrame, queries: DataFrame, held, pivots: int, k: int, s: Settings, files: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best of what the first ``files`` inverted files of each query hold."""
    kind = vectors.schema["vector"].dataType.simpleString()
    schema = f"pivot int, vec_id long, order binary, vector {kind}, place int"
    posted = vectors.select("vec_id", "vector").mapInArrow(_post(held, s, False, s.posted), schema)
    asked = queries.select("vec_id", "vector").mapInArrow(_post(held, s, True, files), schema)
    n_vectors = posted.groupBy("pivot").agg(F.ceil(F.count("*") / s.cell_vectors).cast("int").alias("n_cell"))
    n_queries = asked.groupBy("pivot").agg(F.ceil(F.count("*") / s.cell_queries).cast("int").alias("n_block"))
    counts = n_vectors.join(n_queries, "pivot")
    left = _split(asked, counts, "block", "cell").groupBy("pivot", "cell", "block")
    right = _split(posted, counts, "cell", "block").groupBy("pivot", "cell", "block")
    found = left.cogroup(right).applyInArrow(_search_cell(s, pivots, k, files >= pivots), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query, k: int = 20, vector_col: str = "embedding", id_col: str = "vec_id", settings: Settings = Settings()) -> DataFrame:
    """For each row for which ``is_query`` holds, its ``k`` nearest other rows found: ``query_id, rank, vec_id, score``.

    ``score`` is the inner product of the original vectors in double precision; ranks count from 1, nearest first, ties
    to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids;
    where sizes differ, a shorter vector counts as if zeros followed. ``is_query`` is a condition on ``vec_id``, whatever ``id_col`` is called. Rows that repeat an id
    and a vector count once, and no row is the neighbour of its own id. A query whose files hold
    fewer than ``k`` others looks into all files, so that ``k`` are found if there are so many. An empty table gives an
    empty result; other columns are ignored.
    """
    spark, s = df.sparkSession, settings
    rows = usable(small_batches(df), vector_col, id_col)
    facts = rows.agg(F.count("*").alias("n"), F.max("norm").alias("longest")).first()
    wanted = int(min(s.most_pivots, max(s.least_pivots, s.by_root * math.sqrt(facts["n"])), max(1, facts["n"] // 2)))
    # a bounded sample by the hash of the id; pivots are different vectors
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * wanted).select("vector").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(drawn["vector"].combine_chunks())
    keep = np.sort(np.unique(sample, axis=0, return_index=True)[1])[:wanted]
    held = spark.sparkContext.broadcast(_Pivots(sample[keep], float(facts["longest"])))
    queries = rows.where(is_query)
    found = cut(_search(rows, queries, held, len(keep), k, s, min(s.probed, len(keep))))
    ids = rows.select("vec_id").distinct()
    full = min(k, ids.count() - 1)
    have = found.groupBy("query_id").agg(F.count("*").alias("have"))
    short = queries.select("vec_id", "vector").join(have, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("have", F.lit(0)) < full)
    short = cut(short.select("vec_id", "vector"))
    if full <= 0 or short.isEmpty():
        return found
    rest = _search(rows, short, held, len(keep), k, s, len(keep))
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


def nearest_digest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
