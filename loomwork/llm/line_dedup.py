"""Line deduplication over overlapping windows of three lines, in DataFrame operations.

Three consecutive lines make a window. Windows are hashed to 128 bits and grouped over all documents; each repeated
one keeps its first occurrence (smallest document id, then position) and later ones are removed: the line positions
that they cover are merged per document and taken out of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import free_names, id_order, without

WIDTH = 3


def repeated_windows(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Later occurrences of repeated windows: ``doc_order``, ``text_key``, ``position``.

    A hot window's occurrences are counted before the shuffle, and the join with the few repeated windows is one that
    Spark splits when a key is skewed.
    """
    lines = df.select("doc_order", "text_key", F.split(F.col("text"), "\n").alias("lines")).where(F.size("lines") >= width)
    # one 128-bit digest per line first: windows then hash short strings
    digests = lines.select("doc_order", "text_key", F.transform("lines", lambda x: F.concat(F.xxhash64(x).cast("string"), F.lit(":"), F.xxhash64(F.reverse(x), F.lit(7)).cast("string"))).alias("d"))
    spots = digests.select("doc_order", "text_key", "d", F.explode(F.sequence(F.lit(0), F.size("d") - width)).alias("position"))
    joined = F.concat_ws("|", *(F.col("d")[F.col("position") + k] for k in range(width)))
    windows = spots.select("doc_order", "text_key", "position", F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(7), joined).alias("h2"))
    # grouped under another key than the join's, so that the join gets exchanges which Spark splits where a window is hot
    first = windows.groupBy(F.struct("h1", "h2").alias("k")).agg(F.count("*").alias("times"), F.min(F.struct("doc_order", "position")).alias("first"))
    first = first.where("times > 1").select("k.h1", "k.h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("doc_order", "position") != F.col("first"))
    return later.select("doc_order", "text_key", "position")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_covered(lines: Column, positions: Column, width: int) -> Column:
    """``lines`` less the ``width`` lines from each of the sorted ``positions`` on, in time that grows with the lines alone.

    Covered stretches are merged: one begins at a position that the one before does not reach; what lies between two is sliced.
    """

    def cut(x: Column) -> Column:
        first, last = F.lit(0), F.size(x["at"]) - 1
        begins = F.filter(x["at"], lambda p, i: (i == first) | (p > F.get(x["at"], i - 1) + width))
        ends = F.filter(x["at"], lambda p, i: (i == last) | (F.get(x["at"], i + 1) > p + width))
        return _let(F.struct(x["lines"].alias("lines"), begins.alias("begins"), ends.alias("ends")), between)

    def between(x: Column) -> Column:
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(x["ends"], k - 1) + width)
        stop = lambda k: F.coalesce(F.get(x["begins"], k), F.size(x["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["begins"])), lambda k: F.slice(x["lines"], start(k) + 1, stop(k) - start(k))))

    return _let(F.struct(lines.alias("lines"), positions.alias("at")), cut)


def line_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``df`` with ``text_col`` less its repeated lines, plus ``n_lines`` and ``n_removed``.

    Lines are what lies between newline characters, compared whole; windows of ``width`` lines lie in one document.
    Null texts stay null (no lines); texts with fewer lines than ``width`` stay as they are. Null ids sort first. Rows
    that repeat an id and text are one document: neither is a later occurrence of the other. Columns of ``df`` named like
    the two new ones are replaced, all others stay; an empty table gives an empty result. Ids must be whole numbers, or
    text that reads as such. A text's lines are held as one row, however many they are.
    """
    df = without(df, "n_lines", "n_removed")
    kept = [c for c in df.columns if c != text_col]
    raw, order, key, covered = free_names(df, "_text", "_order", "_key", "_covered")
    base = df.select(*kept, F.col(text_col).alias(raw), id_order(id_col).alias(order), F.xxhash64(F.col(text_col)).alias(key))
    slim = base.select(F.col(order).alias("doc_order"), F.col(key).alias("text_key"), F.col(raw).alias("text")).where("text is not null")
    later = repeated_windows(slim, width)
    spots = later.groupBy(F.col("doc_order").alias(order), F.col("text_key").alias(key)).agg(F.sort_array(F.collect_set("position")).alias(covered))
    joined = base.join(spots, [order, key], "left")
    lines = F.split(raw, "\n")
    rest = F.when(F.col(covered).isNull(), lines).otherwise(without_covered(lines, F.col(covered), width))
    both = _let(F.struct(F.size(lines).alias("n"), rest.alias("rest")), lambda x: F.struct(x["n"].alias("n"), (x["n"] - F.size(x["rest"])).alias("gone"), F.array_join(x["rest"], "\n").alias("text")))
    (found,) = free_names(base, "_found")
    joined = joined.withColumn(found, F.when(F.col(raw).isNotNull(), both))
    return joined.select(
        *kept,
        F.col(found)["text"].alias(text_col),
        F.coalesce(F.col(found)["n"], F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col(found)["gone"], F.lit(0)).cast("long").alias("n_removed"),
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    cleaned = line_dedup(docs.select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
