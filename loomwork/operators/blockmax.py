"""Rank-safe search of a TF-IDF index by blocks: what can't reach a query's k-th score is never joined.

Chunks are numbered by their heaviest term, so that those about the same things lie together, and cut into blocks of a few
dozen. For each term and block the index keeps the largest weight. A query's weights times these, summed over its terms,
bound the score of every chunk in a block. First the blocks with the highest bounds are scored, which gives each query a
k-th score; then only those of the others whose bound reaches it. The result is that of scoring everything.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators.tfidf import PLACES, TfIdfIndex, exploded, posting_weight, query_vectors, with_blanks, with_idf
from loomwork.operators.windows import numbered, shared_folder

#: Chunks of a block, and blocks that are scored first for each query (as many more as hold ``k`` chunks).
BLOCK_CHUNKS, FIRST_BLOCKS = 32, 4
#: Bounds are sums of products, as scores are, but in another order.
SLACK = 1e-9


@dataclass
class BlockIndex:
    """``postings`` (term, block, chunk_id, row, weight) and ``tops`` (term, block, top): the largest weight of a term in a block."""

    index: TfIdfIndex
    postings: DataFrame
    tops: DataFrame

    @classmethod
    def of(cls, index: TfIdfIndex, path: str | None = None, size: int = BLOCK_CHUNKS) -> BlockIndex:
        """The blocks of an index, as Parquet below ``path`` (a folder of its own in the shared one, if none is given)."""
        spark = index.chunks.sparkSession
        path = path or f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
        heaviest = index.postings.groupBy("chunk_id").agg(F.max_by("term", F.struct("weight", "term")).alias("about"))
        placed = numbered(heaviest, "place", "about", "chunk_id").select("chunk_id", F.floor(F.col("place") / size).cast("int").alias("block"))
        if index.held is None:
            postings = index.postings.join(placed, "chunk_id")
        else:  # a chunk's terms get their block together
            postings = with_idf(exploded(index.held.join(placed, "chunk_id")), index.idf, index.common).withColumn("weight", posting_weight())
        postings = postings.select("term", "block", "chunk_id", "row", "weight")
        postings.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
        postings.groupBy("term", "block").agg(F.max("weight").alias("top")).write.mode("overwrite").parquet(f"{path}/tops")
        return cls(index, postings, spark.read.parquet(f"{path}/tops"))


def bounds(vectors: DataFrame, blocks: BlockIndex) -> DataFrame:
    """``query_id, block, bound``: no chunk of the block scores higher. ``vectors`` has ``query_id, term, q``."""
    return vectors.join(blocks.tops, "term").groupBy("query_id", "block").agg(F.sum(F.col("q") * F.col("top")).alias("bound"))


def _scored(chosen: DataFrame, vectors: DataFrame, blocks: BlockIndex) -> DataFrame:
    """Scores of all chunks in the chosen blocks (``query_id, block``)."""
    pairs = chosen.join(vectors, "query_id").join(blocks.postings, ["block", "term"])
    return pairs.groupBy("query_id", "chunk_id", "row").agg(F.round(F.sum(F.col("q") * F.col("weight")), PLACES).alias("score")).where("score > 0")


def plan_blocks(vectors: DataFrame, blocks: BlockIndex, k: int, first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search needs: the scores in the first blocks, the other blocks that may still matter, and all bounds. All three are stored."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # blocks in order of their bounds; only the first few of a query leave a task
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    all_ = kept(bounds(vectors, blocks), "bounds")
    first = all_.withColumn("n", order).where(F.col("n") <= first_blocks).select("query_id", "block")
    scored = kept(_scored(first, vectors, blocks), "first")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row", "chunk_id"))
    kth = scored.withColumn("n", rank).where(F.col("n") == k).select("query_id", F.col("score").alias("kth"))
    open_ = all_.join(first.withColumn("done", F.lit(True)), ["query_id", "block"], "left").where("done is null").join(kth, "query_id", "left")
    return scored, kept(open_.where(F.col("bound") >= F.coalesce("kth", F.lit(0.0)) - SLACK).select("query_id", "block"), "open"), all_


def search(queries: DataFrame, blocks: BlockIndex, k: int, id_col: str = "query_id", text_col: str = "query", first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """``query_id, rank, chunk_id, row, score``: the same rows as ``tfidf.search`` gives.

    A query without a known term has the first chunks with score 0, as there; an empty table of queries gives no row.
    """
    vectors = query_vectors(queries, blocks.index, id_col, text_col).withColumnRenamed("weight", "q")
    vectors.write.parquet(path := f"{shared_folder(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}")
    vectors = vectors.sparkSession.read.parquet(path)
    scored, open_, _ = plan_blocks(vectors, blocks, k, first_blocks)
    return with_blanks(scored.unionByName(_scored(open_, vectors, blocks)), queries.select(F.col(id_col).alias("query_id")), blocks.index, k)
