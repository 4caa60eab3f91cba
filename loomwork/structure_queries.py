"""Queries of page layout, paragraphs, sections, units, reports and checks over the driver's tables.

The tables hold neither pages nor files: pages of placed words, file names and headed texts are made from ``documents`` by
rules of their ids and line numbers, the same in the SQL. All run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import chunking, dense, layout, prompts, reports, retrieval, structure, validation, windows
from loomwork.queries import _graded, benchmark_queries, documents, table, units

LINES_A_PAGE = 12


def placed_words(spark, sf_dir) -> DataFrame:
    """Each document as a file of pages of twelve lines; the first and last lines lie in the margins, and some are page markers."""
    lines = documents(spark, sf_dir).select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.withColumn("line", F.when(F.col("i") % 9 == 4, F.format_string("=== PAGE %d ===", "i")).otherwise(F.col("line")))
    at = F.col("i") % LINES_A_PAGE
    y0 = (30 + 86 * at).cast("double")
    rows = lines.select("file", (F.floor(F.col("i") / LINES_A_PAGE) + 1).cast("int").alias("page"), F.lit(1000.0).alias("page_height"), at.alias("line_no"), F.floor(at / 2).cast("int").alias("block_no"), y0.alias("y0"), (y0 + 10 + F.col("i") % 3 * 5).alias("y1"), F.posexplode(F.split("line", " ")).alias("word_no", "token"))
    return rows.withColumns({"x0": (50 + F.col("word_no") * 7).cast("double"), "x1": (56 + F.col("word_no") * 7).cast("double")})


def page_lines(spark, sf_dir):
    """Words to lines within the margins."""
    rows = layout.words_to_lines(placed_words(spark, sf_dir))
    return rows.select("file", "page", "block_no", "line_no", "min_x", "max_x", "min_y", "max_y", "height", F.md5("text").alias("text_md5"))


def page_paragraphs(spark, sf_dir):
    """Lines to paragraphs."""
    rows = layout.lines_to_paragraphs(layout.words_to_lines(placed_words(spark, sf_dir)))
    return rows.select("file", "page", "paragraph_no", F.md5("text").alias("text_md5"))


def extracted_texts(spark, sf_dir):
    """Files put together from pages, with their markers."""
    rows = layout.extract_text(placed_words(spark, sf_dir), "words")
    return rows.select("file", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def block_texts(spark, sf_dir):
    """Pages put together from blocks, from top left; each line is a block here."""
    words = placed_words(spark, sf_dir)
    blocks = words.groupBy("file", "page", "line_no").agg(F.first("page_height").alias("page_height"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "token"))), lambda w: w["token"]), " ").alias("text"))
    return layout.blocks_to_text(blocks).select("file", "page", F.md5("text").alias("text_md5"))


def document_blocks(spark, sf_dir):
    """Whole documents to blocks, long ones split at numbers, titles and sentences."""
    blocks = F.posexplode(structure.file_blocks(F.col("text"))).alias("n", "block")
    return documents(spark, sf_dir).where("text is not null").select("doc_id", blocks).select("doc_id", "n", T.word_count(F.col("block")).alias("words"), F.md5("block").alias("block_md5"))


def headed_files(spark, sf_dir) -> DataFrame:
    """Each document as a file in which lines are blocks, every third one under a title of its own."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Part "), F.when(F.col("doc_id") % 2 == 0, F.lit("One Of Many")).otherwise("The Other Half"), F.lit("\n\n"))).otherwise("")
    text = F.concat(title, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    return documents(spark, sf_dir).select(name.alias("doc_id"), name.alias("doc_title"), F.concat(name, F.lit("_ch1" + structure.SUFFIX)).alias("source_file"), F.lit(0).alias("source_file_index"), text.alias("text"))


def document_paragraphs(spark, sf_dir):
    """Headers attached to what follows, types and offsets."""
    rows = structure.build_paragraphs(headed_files(spark, sf_dir))
    return rows.select("doc_id", "paragraph_id", "source_block_start", "source_block_end", "has_attached_header", "header_is_noisy", "paragraph_type", "word_count", "char_start_in_doc", "char_end_in_doc", F.md5("text").alias("text_md5"))


def section_nodes(spark, sf_dir):
    """Nodes of files by their names, with their paragraphs' ids and bounds. Documents make seven books of many files."""
    k, book = F.col("doc_id"), F.concat(F.lit("book"), (F.col("doc_id") % 7).cast("string"))
    number = k.cast("string")
    rest = (
        F.when(k % 5 == 0, F.concat(F.lit("ch"), number, F.lit("_sec"), (k % 4).cast("string"), F.lit("a")))
        .when(k % 5 == 1, F.concat(F.lit("ch1_ch"), number, F.lit("_the-inner-parts"), number))
        .when(k % 5 == 2, F.concat(F.lit("intro_note-"), number))
        .when(k % 5 == 3, F.concat(F.lit("pt2_sec"), number, F.lit("_what they_need")))
        .otherwise(F.concat(F.lit("odd"), number))
    )
    name = F.concat(F.when(k % 11 == 0, F.lit("other")).otherwise(book), F.lit("_"), rest, F.lit(structure.SUFFIX))
    files = documents(spark, sf_dir).select(book.alias("doc_id"), book.alias("doc_title"), name.alias("source_file"), k.cast("int").alias("source_file_index"), F.coalesce("text", F.lit("")).alias("text"))
    lines = files.select("doc_id", "source_file", "source_file_index", F.posexplode(F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")).alias("local", "line"))
    numbered = windows.numbered(lines, "paragraph_id", "source_file_index", "local", key="doc_id")
    named = structure.structure_from_name(files).select("source_file", "node_id")
    paragraphs = numbered.join(named, "source_file").select("doc_id", "node_id", "paragraph_id", F.col("paragraph_id").alias("char_start_in_doc"), (F.col("paragraph_id") + F.length("line")).alias("char_end_in_doc"))
    nodes = structure.build_nodes(files, paragraphs)
    ids = F.col("paragraph_ids")
    return nodes.select("doc_id", "node_id", "chapter_label", "section_label", "part_label", "section_path_str", F.size(ids).alias("n_paragraphs"), F.get(ids, F.lit(0)).alias("first_paragraph"), "char_start_in_doc", "char_end_in_doc")


def natural_files(spark, sf_dir):
    """Files in the order in which people sort names, also with numbers of very many digits."""
    long = F.repeat(F.lit("7"), (F.col("doc_id") % 3 * 10).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", F.col("source"), F.concat(F.lit("File"), F.col("doc_id").cast("string"), F.lit("_p"), long, F.lit("9.txt")).alias("name"))
    numbered = windows.numbered(rows.withColumn("key", structure.natural_order(F.col("name"))), "place", "key", key="source")
    return numbered.select("doc_id", "place")


def document_units(spark, sf_dir):
    """Whole documents as paragraphs, long ones as groups of sentences with their offsets."""
    d = documents(spark, sf_dir).where("text is not null")
    kept = {c: F.lit("x") for c in ("doc_title", "node_id", "node_type", "section_path_str", "chapter_label", "section_label", "part_label", "source_file", "paragraph_type")}
    paragraphs = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("paragraph_id"), F.array(F.lit("x")).alias("section_path"), F.lit(0).alias("source_file_index"), F.lit(100).alias("char_start_in_doc"), (F.length("text") + 100).alias("char_end_in_doc"), "text").withColumns(kept)
    found = chunking.build_units(paragraphs)
    return found.select("unit_id", "split_count_within_paragraph", "word_count", "token_count_est", "char_start_in_doc", "char_end_in_doc", F.md5("text").alias("text_md5"))


def chunk_manifest(spark, sf_dir):
    """Chunks and tokens of each document in each partition."""
    chunks = chunking.flat_chunks(units(spark, sf_dir), chunking.SMALL_FIXED)
    parents, _ = chunking.hierarchical_chunks(units(spark, sf_dir))
    both = chunks.unionByName(parents)
    return both.groupBy("retrieval_setting", "source_doc_id").agg(F.count("*").alias("rows"), F.sum("token_count_est").alias("tokens"))


def compared_conditions(spark, sf_dir):
    """Hits of the three conditions side by side."""
    d = documents(spark, sf_dir)
    own = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"source_title": F.lit("t"), "section_path_str": F.lit("s"), "chunk_index": F.lit(0)})
    none = F.lit(None).cast("string")
    whole = [own.withColumns({"chunk_id": F.concat("source_doc_id", F.lit(f"::{s}")), "retrieval_setting": F.lit(s), "parent_id": none}) for s in ("small_fixed", "hierarchical_parent")]
    lines = units(spark, sf_dir).select("source_doc_id", "text", F.lit("t").alias("source_title"), F.lit("s").alias("section_path_str"), F.col("parent_paragraph_id").alias("chunk_index"), F.col("unit_id").alias("chunk_id"))
    parts = [lines.withColumns({"retrieval_setting": F.lit("medium_overlap"), "parent_id": none}), lines.withColumns({"retrieval_setting": F.lit("hierarchical_child"), "parent_id": F.concat("source_doc_id", F.lit("::hierarchical_parent"))})]
    chunks = whole[0]
    for more in (whole[1], *parts):
        chunks = chunks.unionByName(more)
    found = retrieval.compare_conditions(benchmark_queries(spark, sf_dir), windows.written(chunks))
    ids = lambda c: F.concat_ws(" ", F.transform(c, lambda h: h["chunk_id"]))
    return found.select("query_id", "condition", ids("hits").alias("hits"), ids("parent_hits").alias("parent_hits"))


def vignette_windows(spark, sf_dir):
    """Consultation windows of conversations with their query texts and slugs."""
    turn = F.struct(F.col("turn").cast("int").alias("turn_id"), F.col("role").alias("speaker"), F.col("text").alias("utterance"))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("transcript"), F.min("turn").cast("int").alias("first"), F.max("turn").cast("int").alias("last"))
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    window = lambda name, a, z: F.struct(F.lit(name).alias("window_id"), F.array(a, z).alias("turn_range"), F.lit("g").alias("target_ifs_goal"), F.lit("e").alias("expected_retrieval_theme"))
    halves = F.array(window("W1", F.col("first"), middle), window("W2", middle + 1, F.col("last")))
    said = lambda w: F.exists("transcript", lambda t: t["turn_id"].between(w["turn_range"][0], w["turn_range"][1]) & (T.strip(F.coalesce(t["utterance"], F.lit(""))) != ""))
    talks = talks.withColumn("halves", F.filter(halves, said))
    vignettes = talks.select(F.concat(F.lit("V"), F.col("conv_id").cast("string")).alias("vignette_id"), "transcript", F.col("halves").alias("consultation_windows"))
    return windows.window_texts(vignettes).select("vignette_id", "window_id", "slug", F.md5("query").alias("query_md5"))


def metric_heatmap(spark, sf_dir):
    """Mean scores, metrics down and conditions across."""
    found = reports.heatmap(_graded(spark, sf_dir))
    return found.select("metric", *(F.round(c, 6).alias(c) for c in reports.ORDER))


def radar_points(spark, sf_dir):
    """Points of each condition's polygon."""
    means = reports.metric_means(_graded(spark, sf_dir).where(F.col("condition").isin(*reports.ORDER)))
    return reports.radar(means).select("condition", "metric", F.round("angle", 6).alias("angle"), "value")


def known_metrics(spark, sf_dir):
    """Graded rows in which a metric is known."""
    graded = _graded(spark, sf_dir)
    found = reports.known_metric(graded, "grounding_score")
    return found.groupBy("condition").agg(F.count("*").alias("n"))


def row_gaps(spark, sf_dir):
    """Embedded rows whose number isn't their place in the partition."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").cast("int").alias("row"))
    return validation.gaps_in_rows(rows, "row", "label").select("vec_id", "label", "row", "expected_row")


def empty_texts(spark, sf_dir):
    """Turns without text, blank ones too."""
    return validation.empty_texts(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


def prepared_passages(spark, sf_dir):
    """Texts to embed behind the model's prefix."""
    rows = table(spark, sf_dir, "benchmark")
    shown = lambda model: F.md5(dense.with_prefix(F.col("text"), model, "passage: "))
    return rows.select("item_id", shown("some/BGE-model").alias("with_prefix"), shown("other").alias("without"))


def validation_slugs(spark, sf_dir):
    """File names of validation runs."""
    return table(spark, sf_dir, "benchmark").select("item_id", prompts.validation_slug(F.col("text")).alias("slug"))


QUERIES = {f.__name__: f for f in (
    page_lines, page_paragraphs, extracted_texts, block_texts, document_blocks, document_paragraphs, section_nodes, natural_files, document_units, chunk_manifest, compared_conditions, vignette_windows, metric_heatmap,
    radar_points, known_metrics, row_gaps, empty_texts, prepared_passages, validation_slugs,
)}
