"""Files to typed paragraphs and section nodes.

``files`` has ``doc_id, doc_title, source_file, source_file_index, text``, one row per file of a document. Blocks and
headers are found within a file's row, without a shuffle; only paragraph numbers and offsets need a document together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions.text import collapse, estimate_tokens, is_likely_header, is_noise_header, is_substantial, let, paragraph_type, plain_characters, strip, title_case, word_count
from loomwork.operators.cleaning import normalize_newlines
from loomwork.operators.packing_folds import merge_small, pack_by_words

MAX_BLOCK_WORDS, TARGET_WORDS, MIN_WORDS = 300, 140, 80
INTRO = ("intro", "introduction", "preface", "foreword", "prologue", "epilogue")
SUFFIX = ".words.txt"
#: Page numbers and rules that a block may begin with, and where long blocks are cut: before numbers, and after a sentence before a run of titles.
LEADING = (r"\A\|\s*\d+\s+", r"\A\d+\s*\n", r"\A_+\s*\z")
NUMBERED = r"\s+(\d+\.\s+)"
TITLED = r"(?<=[.?!])\s+((?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,5}|[A-Z]{2,}(?:\s+[A-Z]{2,}){0,5}))\s+"
#: Between paragraphs of a document, in characters.
GAP = 2


def normalize_whitespace(text: Column) -> Column:
    """Lines without trailing blanks, two line feeds in a row at most, none at the ends."""
    t = F.regexp_replace(normalize_newlines(text), r"(?Um)[^\S\n]+$", "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def normalize_block(block: Column) -> Column:
    lines = F.filter(F.transform(F.split(plain_characters(block), "\n"), strip), lambda x: x != "")
    b = F.array_join(lines, "\n")
    for pattern in LEADING:
        b = F.regexp_replace(b, pattern, "")
    return strip(F.regexp_replace(b, "[ \t]{2,}", " "))


def split_into_blocks(text: Column) -> Column:
    """What lies between blank lines, without empty blocks."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), normalize_block), lambda b: b != "")


def split_oversized(block: Column, most: int = MAX_BLOCK_WORDS, target: int = TARGET_WORDS, least: int = MIN_WORDS) -> Column:
    """A long block as parts that begin at numbers and titles, then as groups of sentences; small ones join the one before."""
    return let(collapse(block), lambda flat: F.when(word_count(flat) <= most, F.array(flat)).otherwise(_regrouped(flat, most, target, least)))


def _regrouped(flat: Column, most: int, target: int, least: int) -> Column:
    marked = F.regexp_replace(flat, NUMBERED, "\n\n$1")
    marked = F.regexp_replace(marked, TITLED, "\n\n$1 ")
    parts = F.filter(F.transform(F.split(marked, r"\n\s*\n"), strip), lambda p: p != "")

    def regroup(part: Column) -> Column:
        pieces = F.filter(F.transform(F.split(part, r"(?<=[.?!])\s+"), strip), lambda s: s != "")
        packed = let(pieces, lambda x: pack_by_words(x, F.transform(x, word_count), lambda w: w > target))
        return F.when(word_count(part) <= most, F.array(part)).otherwise(packed)

    return merge_small(F.flatten(F.transform(parts, regroup)), lambda p: word_count(p) < least)


def expand_blocks(blocks: Column, most: int = MAX_BLOCK_WORDS) -> Column:
    return F.flatten(F.transform(blocks, lambda b: F.when(word_count(b) > most, split_oversized(b, most)).otherwise(F.array(b))))


def file_blocks(text: Column) -> Column:
    return expand_blocks(split_into_blocks(normalize_whitespace(plain_characters(text))))


def attach_headers(blocks: Column) -> Column:
    """Paragraphs of a file: a header and the long block behind it make one. No block is both, so neighbours decide alone."""
    return let(F.transform(blocks, lambda b: F.struct(b.alias("text"), is_likely_header(b).alias("header"), is_substantial(b).alias("long"))), _attached)


def _attached(facts: Column) -> Column:
    def heads(i: Column) -> Column:
        return F.get(facts, i)["header"] & F.coalesce(F.get(facts, i + 1)["long"], F.lit(False))

    def paragraph(f: Column, i: Column) -> Column:
        headed = heads(i)
        text = F.when(headed, F.concat(f["text"], F.lit("\n\n"), F.get(facts, i + 1)["text"])).otherwise(f["text"])
        taken = F.when(i > 0, heads(i - 1)).otherwise(F.lit(False))
        return F.struct(text.alias("text"), F.when(headed, f["text"]).alias("header_text"), i.alias("start"), F.when(headed, i + 1).otherwise(i).alias("end"), taken.alias("taken"))

    return F.filter(F.transform(facts, paragraph), lambda p: ~p["taken"])


def label(token: Column) -> Column:
    return title_case(collapse(F.translate(token, "-_", "  ")))


def structure_from_name(files: DataFrame, doc: str = "doc_id", name: str = "source_file") -> DataFrame:
    """``files`` with what a file's name says: ``node_id, node_type, chapter_label, section_label, part_label, section_path, section_path_str``."""
    stem = F.replace(F.col(name), F.lit(SUFFIX), F.lit(""))
    rest = F.when(stem.startswith(F.concat(doc, F.lit("_"))), stem.substr(F.length(doc) + 2, F.length(stem))).when(stem == F.col(doc), "").otherwise(stem)
    tokens = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "_"))
    last = lambda kind: F.upper(F.try_element_at(F.filter(tokens, lambda t: t.rlike(rf"\A{kind}\d+[a-zA-Z]*\z")), F.lit(-1)))
    others = F.filter(tokens, lambda t: ~t.rlike(r"\A(ch|sec|pt)\d+[a-zA-Z]*\z"))
    coded = F.array_compact(F.array(last("ch"), last("sec"), last("pt"), F.when(F.size(others) > 0, label(F.array_join(others, " ")))))
    path = F.when(F.lower(F.get(tokens, F.lit(0))).isin(*INTRO), F.transform(tokens, label)).otherwise(coded)
    path = F.when(F.size(path) > 0, path).otherwise(F.array(stem))
    return files.withColumns(
        {
            "node_id": F.concat_ws("::", doc, stem, F.lit("node")),
            "node_type": F.lit("section"),
            "chapter_label": last("ch"),
            "section_label": last("sec"),
            "part_label": last("pt"),
            "section_path": path,
            "section_path_str": F.array_join(path, " > "),
        }
    )


NODE = ["source_file", "source_file_index", "node_id", "node_type", "section_path", "section_path_str", "chapter_label", "section_label", "part_label"]


def build_paragraphs(files: DataFrame) -> DataFrame:
    """The paragraphs of all documents with their numbers and character offsets; files without blocks have none."""
    named = structure_from_name(files)
    rows = named.select("doc_id", "doc_title", *NODE, F.posexplode_outer(attach_headers(file_blocks(F.col("text")))).alias("local", "p")).where("p is not null")  # outer, lest a derived filter computes all of it again
    order = W.partitionBy("doc_id").orderBy("source_file_index", "source_file", "local")
    text, size = F.col("p.text"), F.length("p.text")
    before = F.coalesce(F.sum(size + GAP).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.select(
        "doc_id",
        "doc_title",
        (F.row_number().over(order) - 1).alias("paragraph_id"),
        *NODE,
        F.col("p.start").alias("source_block_start"),
        F.col("p.end").alias("source_block_end"),
        F.col("p.header_text").isNotNull().alias("has_attached_header"),
        F.col("p.header_text").alias("header_text"),
        F.coalesce(is_noise_header(F.col("p.header_text")), F.lit(False)).alias("header_is_noisy"),
        paragraph_type(text, F.col("p.header_text")).alias("paragraph_type"),
        word_count(text).alias("word_count"),
        size.alias("char_count"),
        before.alias("char_start_in_doc"),
        (before + size).alias("char_end_in_doc"),
        text.alias("text"),
    )


def build_nodes(files: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row per node with the ids and bounds of its paragraphs; a node without paragraphs has no ids and null bounds."""
    named = structure_from_name(files).select("doc_id", *NODE)
    first = W.partitionBy("doc_id", "node_id").orderBy("source_file_index", "source_file")
    named = named.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    held = paragraphs.groupBy("doc_id", "node_id").agg(
        F.sort_array(F.collect_list("paragraph_id")).alias("paragraph_ids"),
        F.min("char_start_in_doc").alias("char_start_in_doc"),
        F.max("char_end_in_doc").alias("char_end_in_doc"),
    )
    joined = named.join(held, ["doc_id", "node_id"], "left")
    return joined.withColumn("paragraph_ids", F.coalesce("paragraph_ids", F.array().cast("array<int>")))


def quality_report(paragraphs: DataFrame, top: int = 10) -> DataFrame:
    """Per document: paragraphs, their largest, how many are over 300, 500 and 800 words, and the largest counts."""
    over = lambda n: F.count_if(F.col("word_count") > n).alias(f"over_{n}_words")
    rank = W.partitionBy("doc_id").orderBy(F.desc("word_count"), "paragraph_id")
    ranked = paragraphs.select("doc_id", "word_count", "paragraph_id", F.row_number().over(rank).alias("rank"))
    counts = paragraphs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max("word_count").alias("max_words"), over(300), over(500), over(800))
    tops = ranked.where(F.col("rank") <= top).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word_count"))), lambda x: x["word_count"]).alias("largest"))
    return counts.join(tops, "doc_id")


def natural_order(name: Column) -> Column:
    """A key that sorts names as people do: runs of digits count as numbers, however long, and sort before letters."""

    def key(p: Column) -> Column:
        digits = F.regexp_replace(p, r"\A0+(?=\d)", "")
        return F.when(p.rlike(r"\A\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), key), "\u0001")


def files_of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of a corpus table as a document of one file."""
    name = F.concat(F.lit("doc"), F.col(id_col).cast("string"))
    return docs.select(name.alias("doc_id"), title_case(F.translate(name, "_", " ")).alias("doc_title"), F.concat(name, F.lit("_ch1" + SUFFIX)).alias("source_file"), F.lit(0).alias("source_file_index"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def line_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that aren't blank as units of chunks, for texts without paragraphs: each row of ``docs`` is a document of one node.

    Units carry the columns that chunking needs; offsets count as if lines were joined by a blank line.
    """
    name = F.concat(F.lit("doc"), F.col(id_col).cast("string"))
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), strip), lambda x: x != "")
    rows = docs.select(name.alias("source_doc_id"), F.posexplode_outer(lines).alias("n", "text")).where("text is not null")
    before = F.coalesce(F.sum(F.length("text") + GAP).over(W.partitionBy("source_doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.select(
        "source_doc_id", F.col("source_doc_id").alias("source_title"), before.alias("char_start_in_doc"), (before + F.length("text")).alias("char_end_in_doc"), F.col("n").alias("parent_paragraph_id"),
        F.format_string("%s::p%05d::u00", "source_doc_id", "n").alias("unit_id"), F.col("source_doc_id").alias("node_id"), F.array("source_doc_id").alias("section_path"), F.col("source_doc_id").alias("section_path_str"),
        F.col("source_doc_id").alias("source_file"), F.lit(0).alias("source_file_index"), estimate_tokens(F.col("text")).alias("token_count_est"), "text",
    )
