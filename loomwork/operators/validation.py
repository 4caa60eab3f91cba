"""Checks on chunks and vectors: each gives the offending rows; ``require_none`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.windows import numbered


def duplicate_ids(df: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Ids that occur more than once or are missing, and how often."""
    return df.groupBy(id_col).agg(F.count("*").alias("times")).where((F.col("times") > 1) | F.col(id_col).isNull() | (F.trim(id_col) == ""))


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children whose parent isn't there."""
    return children.join(parents.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_anti")


def gaps_in_rows(df: DataFrame, row: str = "embedding_row", partition: str = "embedding_partition") -> DataFrame:
    """Rows whose number isn't their place in the partition's order, counted from 0."""
    return numbered(df, "expected_row", row, key=partition).where(~F.col(row).eqNullSafe(F.col("expected_row")))


def wrong_sizes(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or of another size than the commonest."""
    size = df.groupBy(F.size(vector).alias("usual")).count().orderBy(F.desc("count"), "usual").limit(1).select("usual")
    return df.join(F.broadcast(size)).where(F.col(vector).isNull() | (F.size(vector) != F.col("usual"))).drop("usual")


def empty_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(F.col(text_col).isNull() | (F.trim(text_col) == ""))


def embedding_report(df: DataFrame, partition: str = "embedding_partition", row: str = "embedding_row", vector: str = "embedding") -> DataFrame:
    """Per partition: rows, least and most components, first and last id."""
    return df.groupBy(partition).agg(F.count("*").alias("rows"), F.min(F.size(vector)).alias("min_size"), F.max(F.size(vector)).alias("max_size"), F.min_by("chunk_id", row).alias("first_id"), F.max_by("chunk_id", row).alias("last_id"))


def require_none(df: DataFrame, message: str) -> None:
    found = df.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def validate_chunks(chunks: DataFrame) -> None:
    """Ids must be unique, and children must have their parents."""
    require_none(duplicate_ids(chunks), "chunk ids are missing or repeat")
    kind = lambda k: chunks.where(F.col("retrieval_setting") == k)
    require_none(orphans(kind("hierarchical_child").select("chunk_id", "parent_id"), kind("hierarchical_parent")), "children without a parent")
