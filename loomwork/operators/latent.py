"""A text encoder that is trained here: latent vectors of TF-IDF rows.

The right singular vectors of the matrix of chunks and terms are found by randomised block power iteration. The matrix is
the index's table of postings and is only ever joined: a block of vectors over the terms goes to the chunks and back, and
is made orthonormal by its Gram matrix, which tasks add up from their own rows. What reaches the driver is that matrix,
of the size of the block, whatever the chunks and terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.tfidf import TfIdfIndex, exploded, posting_weight, query_vectors, term_counts, with_idf
from loomwork.operators.windows import written

#: Vectors beyond those wanted, and rounds over the matrix; both sharpen what is found.
OVERSAMPLE, ROUNDS = 8, 3


def _names(width: int) -> list[str]:
    return [f"v{k}" for k in range(width)]


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _names(width)], axis=1)


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _rows(batch, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    return run


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """The inner products of the columns of ``rows``: one number for each two of them is collected."""
    parts = rows.select(*_names(width)).mapInArrow(_gram(width), "g array<double>").select(F.posexplode("g").alias("at", "x"))
    out = np.zeros(width * width)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(width, width)


def _times(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Each row's vector times a small matrix."""
    before, after = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, before) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=[key, *_names(after)])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *_names(before)).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{c} double" for c in _names(after))]))


def _carried(index: TfIdfIndex, vectors: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """The matrix (or its transpose) times a block of vectors: joined on one key, summed by the other.

    Of a stored index, whose chunks have their terms in one row, no posting is shuffled with a vector, save those of rare
    terms: common terms' vectors go to where the chunks lie, whose sums are whole there; and a chunk's vector meets all its
    terms at once, whose sums leave a task as one row each.
    """
    sums = [F.sum(F.col("weight") * F.col(c)).alias(c) for c in _names(width)]
    if index.held is None:
        return index.postings.select("term", "chunk_id", "weight").join(vectors, by).groupBy(to).agg(*sums)
    if by == "term":
        table = index.idf.select("term", "idf").join(vectors, "term")
        rows = with_idf(exploded(index.held.select("chunk_id", "length", "runs")), table, written(table.join(F.broadcast(index.common.select("term")), "term", "left_semi")))
    else:
        rows = with_idf(exploded(index.held.select("chunk_id", "length", "runs").join(vectors, "chunk_id")), index.idf, index.common)
    return rows.withColumn("weight", posting_weight()).groupBy(to).agg(*sums)


@dataclass
class LatentModel:
    """``terms`` (term, vector) of ``size`` components, the singular values, and the index whose frequencies weigh texts."""

    index: TfIdfIndex
    terms: DataFrame
    values: np.ndarray

    @classmethod
    def fit(cls, index: TfIdfIndex, size: int = 64, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, seed: int = 1) -> LatentModel:
        """The first ``size`` singular vectors; fewer if the matrix has no more. An index without terms gives vectors of size 0."""
        width = size + oversample
        sign = lambda k: F.when(F.xxhash64("term", F.lit(seed), F.lit(k)) > 0, 1.0).otherwise(-1.0)
        basis = index.idf.select("term", *(sign(k).alias(c) for k, c in enumerate(_names(width))))
        for _ in range(rounds):
            at_chunks = written(_carried(index, basis, "term", "chunk_id", width))
            raw = written(_carried(index, at_chunks, "chunk_id", "term", width))
            square, turn = np.linalg.eigh(gram(raw, width))
            kept = square > 1e-12 * max(square.max(initial=0.0), 1e-300)
            basis, width = _times(raw, "term", turn[:, kept] / np.sqrt(square[kept])), int(kept.sum())
            if not width:
                return cls(index, index.idf.select("term", F.array().cast("array<double>").alias("vector")), np.zeros(0))
        basis = written(basis)
        square, turn = np.linalg.eigh(gram(_carried(index, basis, "term", "chunk_id", width), width))
        kept = np.argsort(-square)[: min(size, width)]
        kept = kept[square[kept] > 1e-12 * max(square.max(initial=0.0), 1e-300)]
        terms = _times(basis, "term", turn[:, kept]).select("term", F.array(*_names(len(kept))).alias("vector"))
        return cls(index, written(terms), np.sqrt(square[kept]))

    def encode(self, df: DataFrame, id_col: str, text_col: str = "text", into: str = "embedding") -> DataFrame:
        """``id_col, into`` for each id: the unit vector (floats) of its text; zeros for texts without a known term. Ids must differ."""
        size = len(self.values)
        if not size:
            return df.select(id_col, F.array().cast("array<float>").alias(into))
        if self.index.held is None:
            weights = query_vectors(df, self.index, id_col, text_col).join(self.terms, "term")
        else:  # the text's own length doesn't matter: what is summed up is made one long
            counts = term_counts(df.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text")), "text", self.index.stop_words)
            table = self.index.idf.select("term", "idf").join(self.terms, "term")
            common = written(table.join(F.broadcast(self.index.common.select("term")), "term", "left_semi"))
            weights = with_idf(counts, table, common).withColumn("weight", F.col("tf") * F.col("idf"))
        parts = weights.select("query_id", *((F.col("weight") * F.col("vector")[k]).alias(c) for k, c in enumerate(_names(size))))
        sums = parts.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in _names(size)))
        length = F.sqrt(sum((F.col(c) * F.col(c) for c in _names(size)), F.lit(0.0)))
        unit = F.array(*(F.when(F.col("length") > 0, F.col(c) / F.col("length")).otherwise(0.0).cast("float") for c in _names(size)))
        found = sums.withColumn("length", length).select(F.col("query_id").alias(id_col), unit.alias(into))
        blank = F.array_repeat(F.lit(0.0).cast("float"), size)
        return df.select(id_col).join(found, id_col, "left").withColumn(into, F.coalesce(into, blank))


def share_in_common(a: DataFrame, b: DataFrame, keys: list[str]) -> float:
    """The share of rows of ``a`` whose keys are in ``b`` too: how far two searches agree."""
    n = a.count()
    return a.join(b.select(*keys).distinct(), keys, "left_semi").count() / n if n else 1.0
