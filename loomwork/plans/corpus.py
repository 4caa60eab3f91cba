"""Corpus build: raw files to clean texts, paragraphs, chunks, vectors and indexes, as one lazy plan with written tables between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import chunking, cleaning, dense, structure, validation, windows
from loomwork.operators.retrieval import fit_partition
from loomwork.operators.tfidf import TfIdfIndex
from loomwork.sources import sinks


@dataclass
class Corpus:
    paragraphs: DataFrame
    nodes: DataFrame
    chunks: DataFrame


def build(files: DataFrame, path: str, clean: bool = True) -> Corpus:
    """``files`` (doc_id, doc_title, source_file, source_file_index, text) to the tables below ``path``.

    What several tables are made of is written once and read again. Chunks are checked before they are returned.
    """
    spark = files.sparkSession
    cleaned = cleaning.clean(files) if clean else files
    cleaned.write.mode("overwrite").parquet(f"{path}/files")
    files = spark.read.parquet(f"{path}/files")
    structure.build_paragraphs(files).write.mode("overwrite").parquet(f"{path}/paragraphs")
    paragraphs = spark.read.parquet(f"{path}/paragraphs")
    structure.build_nodes(files, paragraphs).write.mode("overwrite").parquet(f"{path}/nodes")
    chunking.build_units(paragraphs).write.mode("overwrite").parquet(f"{path}/units")
    sinks.write_partitions(with_book_order(chunking.chunk_corpus(spark.read.parquet(f"{path}/units"))), f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    validation.validate_chunks(chunks)
    return Corpus(paragraphs, spark.read.parquet(f"{path}/nodes"), chunks)


def with_book_order(chunks: DataFrame) -> DataFrame:
    """Chunks with the place of their document among all, by name (documents are numbered from their distinct names)."""
    numbered = windows.numbered(chunks.select("source_doc_id").distinct(), "book_order", "source_doc_id")
    return chunks.join(numbered, "source_doc_id")


def embed(chunks: DataFrame, path: str, model: str = "hashed", prefix: str = "", encoder=None) -> DataFrame:
    """Chunks with unit vectors and a row number in their partition, in a folder per setting."""
    numbered = windows.numbered(chunks, "embedding_row", "source_doc_id", "chunk_index", key="retrieval_setting")
    rows = dense.embed(numbered.withColumn("_passage", dense.with_prefix(F.col("text"), model, prefix)), encoder, "_passage").drop("_passage")
    rows = rows.withColumn("embedding_partition", F.col("retrieval_setting"))
    sinks.write_partitions(rows, path)
    return chunks.sparkSession.read.parquet(path)


def index(chunks: DataFrame, setting: str, path: str) -> TfIdfIndex:
    return fit_partition(chunks, setting).saved(path)
