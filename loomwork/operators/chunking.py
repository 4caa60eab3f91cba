"""Paragraphs to units, and units to chunks: fixed windows, overlapping windows, and parents with children.

A document's units (a node's, for children) are gathered once; folds over their token counts say where chunks begin and
end, and the chunks are sliced from the gathered array. A document must fit a task, the corpus need not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions.text import estimate_tokens, let, sentences, slug, strip, tokens_of_words, word_count
from loomwork.operators.packing_folds import merge_small, pack_by_words, pack_with_overlap, pack_without_overlap

JOINER = "\n\n"
SPLIT_OVER, SEGMENT_TARGET, SEGMENT_LEAST = 420, 180, 80


@dataclass(frozen=True)
class ChunkSetting:
    name: str
    strategy: str
    target_tokens: int
    min_tokens: int
    overlap_tokens: int = 0


SMALL_FIXED = ChunkSetting("small_fixed", "fixed_window_no_overlap", 350, 120)
MEDIUM_OVERLAP = ChunkSetting("medium_overlap", "fixed_window_with_overlap", 900, 300, 180)
CHILD = ChunkSetting("hierarchical_child", "fixed_window_within_node", 300, 120)
PARENT_STRATEGY, PARENT_TARGET = "node_as_parent", 1200


def _segments(text: Column) -> Column:
    """The segments of a paragraph, null if it stays whole."""

    def grouped(parts: Column) -> Column:
        packed = pack_by_words(parts, F.transform(parts, word_count), lambda w: tokens_of_words(w) > SEGMENT_TARGET)
        return F.when(F.size(parts) > 1, merge_small(packed, lambda s: estimate_tokens(s) < SEGMENT_LEAST))

    return F.when(estimate_tokens(text) > SPLIT_OVER, let(sentences(text), grouped))


def _starts(text: Column, segments: Column) -> Column:
    """Where each segment is found behind the one before it; one that isn't found is put where the last ended."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("next"))

    def step(s: Column, segment: Column) -> Column:
        found = F.call_function("locate", segment, text, s["next"] + 1)
        start = F.when(found > 0, found - 1).otherwise(s["next"])
        return F.struct(F.concat(s["starts"], F.array(start)).alias("starts"), (start + F.length(segment)).alias("next"))

    return F.aggregate(segments, zero, step, lambda s: s["starts"])


def build_units(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs, those over 420 tokens as groups of sentences, with ids and offsets in the document."""
    rows = paragraphs.where(strip(F.col("text")) != "").withColumn("segments", _segments(F.col("text")))
    rows = rows.withColumns({"whole": F.col("segments").isNull(), "segments": F.coalesce("segments", F.array(strip(F.col("text"))))})
    rows = rows.withColumn("starts", F.when(F.col("whole"), F.array(F.lit(0))).otherwise(_starts(F.col("text"), F.col("segments"))))
    rows = rows.select("*", F.posexplode_outer("segments").alias("n", "segment"))
    start = F.col("char_start_in_doc") + F.col("starts")[F.col("n")]
    end = F.when(F.col("whole"), F.col("char_end_in_doc")).otherwise(start + F.length("segment"))
    kept = ["node_id", "node_type", "section_path", "section_path_str", "chapter_label", "section_label", "part_label", "source_file", "source_file_index", "paragraph_type"]
    return rows.select(
        F.format_string("%s::p%05d::u%02d", "doc_id", "paragraph_id", "n").alias("unit_id"),
        F.col("paragraph_id").alias("parent_paragraph_id"),
        F.col("doc_id").alias("source_doc_id"),
        F.col("doc_title").alias("source_title"),
        *kept,
        start.alias("char_start_in_doc"),
        end.alias("char_end_in_doc"),
        F.col("segment").alias("text"),
        word_count(F.col("segment")).alias("word_count"),
        estimate_tokens(F.col("segment")).alias("token_count_est"),
        F.col("n").alias("split_index_within_paragraph"),
        F.when(F.col("whole"), 1).otherwise(F.size("segments")).alias("split_count_within_paragraph"),
    )


_UNIT = ["char_start_in_doc", "char_end_in_doc", "parent_paragraph_id", "unit_id", "node_id", "section_path", "section_path_str", "source_file", "source_file_index", "token_count_est", "text"]


def _gathered(units: DataFrame, *keys: str) -> DataFrame:
    """``units``: an array of a key's units in the order of their offsets."""
    return units.groupBy("source_doc_id", "source_title", *keys).agg(F.sort_array(F.collect_list(F.struct(*_UNIT))).alias("units"))


def chapter_slug(path: Column) -> Column:
    chapter = F.get(F.filter(path, lambda x: F.lower(x).rlike(r"\Ach\d+[a-z]*\z")), F.lit(0))
    return slug(F.coalesce(chapter, F.get(path, F.lit(0)), F.lit("root")))


def _chunk_columns(own: Column, setting: str, strategy: str, target: int, overlap: int, node_type: str) -> dict[str, Column]:
    """What a chunk says of its units ``own``; ids and links come later."""
    text = strip(F.array_join(F.transform(own, lambda u: u["text"]), JOINER))
    each = lambda field: F.array_distinct(F.transform(own, lambda u: u[field]))
    path = own[0]["section_path"]
    label = lambda n: F.try_element_at(path, F.lit(n))
    return {
        "retrieval_setting": F.lit(setting),
        "chunking_strategy": F.lit(strategy),
        "text": text,
        "node_ids": each("node_id"),
        "primary_node_id": own[0]["node_id"],
        "source_files": each("source_file"),
        "source_file_indices": each("source_file_index"),
        "paragraph_ids": each("parent_paragraph_id"),
        "section_path": path,
        "section_path_str": own[0]["section_path_str"],
        "chapter_label": label(1),
        "section_label": label(2),
        "subsection_label": label(3),
        "char_start_in_doc": F.array_min(F.transform(own, lambda u: u["char_start_in_doc"])),
        "char_end_in_doc": F.array_max(F.transform(own, lambda u: u["char_end_in_doc"])),
        "token_count_est": estimate_tokens(text),
        "char_count": F.length(text),
        "node_type": F.lit(node_type),
        "content_type": F.lit("body_text"),
        "target_tokens": F.lit(target),
        "overlap_tokens": F.lit(overlap),
        "slug": chapter_slug(path),
    }


def _cut(gathered: DataFrame, s: ChunkSetting, node_type: str) -> DataFrame:
    """A row per chunk with its number ``k`` among its key's, and the tokens that it shares with its neighbours."""
    tokens = F.transform("units", lambda u: u["token_count_est"])
    ranges = pack_with_overlap(tokens, s.target_tokens, s.overlap_tokens, s.min_tokens) if s.overlap_tokens else pack_without_overlap(tokens, s.target_tokens, s.min_tokens)
    rows = gathered.withColumn("ranges", ranges).select("*", F.posexplode_outer("ranges").alias("k", "r"))

    def shared(first: Column, stop: Column) -> Column:
        """Tokens of the units from ``first`` up to ``stop``, 0 if there are none."""
        count = F.greatest(F.lit(0), stop - first)
        return F.coalesce(F.aggregate(F.slice("units", first + 1, count), F.lit(0), lambda a, u: a + u["token_count_est"]), F.lit(0))

    before, after = F.get("ranges", F.col("k") - 1), F.get("ranges", F.col("k") + 1)
    rows = rows.withColumns({"overlap_with_prev_tokens": F.when(F.col("k") > 0, shared(F.col("r.start"), before["stop"])).otherwise(0), "overlap_with_next_tokens": F.when(after.isNotNull(), shared(after["start"], F.col("r.stop"))).otherwise(0)})
    rows = rows.withColumn("own", F.slice("units", F.col("r.start") + 1, F.col("r.stop") - F.col("r.start")))
    return rows.withColumns(_chunk_columns(F.col("own"), s.name, s.strategy, s.target_tokens, s.overlap_tokens, node_type)).drop("units", "ranges", "r", "own")


def _linked(chunks: DataFrame, *keys: str, order: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return chunks.withColumns({"prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})


COLUMNS = [
    "chunk_id", "retrieval_setting", "chunking_strategy", "source_doc_id", "source_title", "text", "node_ids", "primary_node_id", "source_files", "source_file_indices", "paragraph_ids",
    "section_path", "section_path_str", "chapter_label", "section_label", "subsection_label", "char_start_in_doc", "char_end_in_doc", "token_count_est", "char_count", "prev_chunk_id",
    "next_chunk_id", "parent_id", "children_ids", "overlap_with_prev_tokens", "overlap_with_next_tokens", "node_type", "content_type", "target_tokens", "overlap_tokens", "chunk_index",
]


def flat_chunks(units: DataFrame, setting: ChunkSetting = SMALL_FIXED) -> DataFrame:
    """Chunks of each document in windows of the setting; the units' own order decides, ``chunk_index`` numbers them."""
    return _flat(_gathered(units), setting)


def _flat(gathered: DataFrame, setting: ChunkSetting) -> DataFrame:
    rows = _cut(gathered, setting, "flat_chunk").withColumnRenamed("k", "chunk_index")
    rows = rows.withColumn("chunk_id", F.format_string("%s::%s::%s::%05d", "source_doc_id", F.lit(setting.name), "slug", "chunk_index"))
    rows = rows.withColumns({"parent_id": F.lit(None).cast("string"), "children_ids": F.array().cast("array<string>")})
    return _linked(rows, "source_doc_id", order="chunk_index").select(*COLUMNS)


def hierarchical_chunks(units: DataFrame, child: ChunkSetting = CHILD) -> tuple[DataFrame, DataFrame]:
    """Parents (all units of a node) and children (windows within it), numbered over the document.

    Parents are linked within a document, children within their parent. Nodes without units have neither. There is no
    bound on a parent's size.
    """
    nodes = _gathered(units, "node_id").withColumn("first", F.col("units")[0]["char_start_in_doc"])
    order = W.partitionBy("source_doc_id").orderBy("first", "node_id")
    nodes = nodes.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("slug", chapter_slug(F.col("units")[0]["section_path"]))
    nodes = nodes.withColumn("parent_id", F.format_string("%s::hier_parent::%s::%05d", "source_doc_id", "slug", "chunk_index"))

    cut = _cut(nodes, child, "child")
    number = F.row_number().over(W.partitionBy("source_doc_id").orderBy("node_no", "k")) - 1
    cut = cut.withColumnRenamed("chunk_index", "node_no").withColumn("chunk_index", number)
    cut = cut.withColumn("chunk_id", F.format_string("%s::hier_child::%s::%05d", "source_doc_id", "slug", "chunk_index")).withColumn("children_ids", F.array().cast("array<string>"))
    children = _linked(cut, "parent_id", order="chunk_index").select(*COLUMNS)

    held = children.groupBy("parent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]).alias("children_ids"))
    whole = nodes.withColumns(_chunk_columns(F.col("units"), "hierarchical_parent", PARENT_STRATEGY, PARENT_TARGET, 0, "parent")).drop("units").join(held, "parent_id")
    whole = whole.withColumnRenamed("parent_id", "chunk_id").withColumns({"parent_id": F.lit(None).cast("string"), "overlap_with_prev_tokens": F.lit(0), "overlap_with_next_tokens": F.lit(0)})
    return _linked(whole, "source_doc_id", order="chunk_index").select(*COLUMNS), children


def chunk_corpus(units: DataFrame) -> DataFrame:
    """All four partitions in one table, told apart by ``retrieval_setting``; both flat ones are cut from documents gathered once."""
    parents, children = hierarchical_chunks(units)
    gathered = _gathered(units)
    return _flat(gathered, SMALL_FIXED).unionByName(_flat(gathered, MEDIUM_OVERLAP)).unionByName(parents).unionByName(children)


def chunk_summary(chunks: DataFrame, *keys: str) -> DataFrame:
    """Count and average (two places), least and most tokens of the chunks of each key; zeros for an empty table without keys."""
    figures = chunks.groupBy(*keys).agg(F.count("*").alias("count"), F.round(F.avg("token_count_est"), 2).alias("avg_tokens"), F.min("token_count_est").alias("min_tokens"), F.max("token_count_est").alias("max_tokens"))
    return figures.fillna(0, ["avg_tokens", "min_tokens", "max_tokens"])
