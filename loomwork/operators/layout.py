"""Pages of placed words to lines, paragraphs and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions.text import ends_paragraph, is_boilerplate, is_heading_line, is_page_marker, starts_paragraph, strip
from loomwork.operators.cleaning import clean_line, normalize_extracted

PAGE = ["file", "page"]


def within_margins(df: DataFrame, top: float = 0.05, bottom: float = 0.03) -> DataFrame:
    """Rows with ``y0, y1`` (and ``page_height``) that don't lie in the margins."""
    return df.where((F.col("y1") >= F.col("page_height") * top) & (F.col("y0") <= F.col("page_height") * (1.0 - bottom)))


def words_to_lines(words: DataFrame, top: float = 0.05, bottom: float = 0.03) -> DataFrame:
    """One row per line of a page: bounding box, height and text; blank words and boilerplate lines go."""
    kept = within_margins(words.withColumn("token", strip(F.col("token"))).where("token <> ''"), top, bottom)
    lines = kept.groupBy(*PAGE, "block_no", "line_no").agg(
        F.min("y0").alias("min_y"),
        F.max("y1").alias("max_y"),
        F.min("x0").alias("min_x"),
        F.max("x1").alias("max_x"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "x0", "token"))), lambda w: w["token"]), " ").alias("text"),
    )
    lines = lines.withColumns({"height": F.col("max_y") - F.col("min_y"), "text": clean_line(F.col("text"))})
    return lines.where((F.col("text") != "") & ~is_boilerplate(F.col("text")))


def reading_order():
    """Top to bottom, then left to right, to a tenth of a point."""
    return [F.bround("min_y", 1), F.bround("min_x", 1), F.col("block_no"), F.col("line_no")]


def lines_to_paragraphs(lines: DataFrame) -> DataFrame:
    """``file, page, paragraph_no, text``: runs of lines between headings, gaps and fresh starts (gaps and islands)."""
    page = W.partitionBy(*PAGE)
    order = page.orderBy(*reading_order())
    marked = lines.withColumns({"marker": is_page_marker(F.col("text")), "order": F.row_number().over(order)})
    # a page marker ends a paragraph but is nobody's predecessor
    marked = marked.withColumn("markers", F.sum(F.col("marker").cast("int")).over(W.partitionBy(*PAGE).orderBy("order")))
    height = F.coalesce(F.median(F.when(F.col("height") > 0, F.col("height"))).over(page), F.lit(10.0))
    rows = marked.withColumn("gap_limit", height * 1.35).where(~F.col("marker"))
    before = W.partitionBy(*PAGE).orderBy("order")
    was = {c: F.lag(c).over(before) for c in ("text", "block_no", "max_y", "markers")}
    heading, fresh = is_heading_line(F.col("text")), starts_paragraph(F.col("text"))
    ended, large = ends_paragraph(F.col("prev_text")), (F.col("min_y") - F.col("prev_max_y")) > F.col("gap_limit")
    changed = F.col("block_no") != F.col("prev_block_no")
    rows = rows.withColumns({f"prev_{c}": v for c, v in was.items()})
    starts = F.col("prev_text").isNull() | (F.col("markers") != F.col("prev_markers")) | heading | is_heading_line(F.col("prev_text")) | (changed & (large | (ended & fresh))) | (large & ended & fresh)
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(before))
    joined = rows.groupBy(*PAGE, "island").agg(F.sort_array(F.collect_list(F.struct("order", "text"))).alias("parts"))
    texts = joined.withColumn("text", normalize_extracted(F.array_join(F.transform("parts", lambda p: p["text"]), " ")))
    texts = texts.where((F.col("text") != "") & ~is_boilerplate(F.col("text")))
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("island")) - 1
    return texts.select(*PAGE, number.alias("paragraph_no"), "text")


def blocks_to_text(blocks: DataFrame, top: float = 0.05, bottom: float = 0.03) -> DataFrame:
    """``file, page, text``: the blocks of a page within its margins, from top left, a blank line between them."""
    kept = within_margins(blocks.withColumn("text", strip(F.col("text"))).where("text <> ''"), top, bottom)
    parts = F.sort_array(F.collect_list(F.struct("y0", "x0", "text")))
    return kept.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def words_to_text(words: DataFrame, top: float = 0.05, bottom: float = 0.03) -> DataFrame:
    """``file, page, text``: paragraphs of a page with a blank line between them."""
    paragraphs = lines_to_paragraphs(words_to_lines(words, top, bottom))
    parts = F.sort_array(F.collect_list(F.struct("paragraph_no", "text")))
    return paragraphs.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def extract_text(pages: DataFrame, mode: str = "words", page_markers: bool = True, top: float = 0.05, bottom: float = 0.03) -> DataFrame:
    """``file, text``: a file's pages in order, empty ones left out, each behind its marker if wanted.

    ``mode`` says what ``pages`` holds: ``words``, ``blocks`` or ``text`` (whole pages). Pages count from 1.
    """
    if mode == "words":
        texts = words_to_text(pages, top, bottom)
    elif mode == "blocks":
        texts = blocks_to_text(pages, top, bottom)
    elif mode == "text":
        texts = pages.select(*PAGE, normalize_extracted(F.col("text")).alias("text"))
    else:
        raise ValueError(f"unknown extraction mode: {mode}")
    texts = texts.where(F.col("text") != "")
    shown = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), F.col("text")) if page_markers else F.col("text")
    parts = F.sort_array(F.collect_list(F.struct("page", shown.alias("text"))))
    return texts.groupBy("file").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
