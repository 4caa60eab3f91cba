"""The registered queries over the driver's tables; each takes a session and a folder of Parquet tables.

Lines of ``documents`` stand for paragraphs, ``conversations`` for transcripts, ``benchmark`` for queries and ``labels``
for scores. All run over their whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import blockmax, cells, chunking, cleaning, dense, jumps, latent, prompts, reports, retrieval, scoring, structure, tfidf, validation, windows
from loomwork.sources import readers

K = 5
WINDOW_TURNS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(table(spark, sf_dir, "documents"), "doc_id")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.line_units(documents(spark, sf_dir))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def doc_index(spark: SparkSession, sf_dir: str) -> tfidf.TfIdfIndex:
    return tfidf.fit(documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id").stored()


def word_token_stats(spark, sf_dir):
    """Words, estimated tokens, sentences and share of capitals of each text."""
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.word_count(t).alias("words"), T.estimate_tokens(t).alias("tokens"), F.size(T.sentences(t)).alias("sentences"), F.round(T.uppercase_ratio(t), 6).alias("uppercase"))


def clean_documents(spark, sf_dir):
    """The cleaned text of each document."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(cleaning.clean_text(F.col("text")), 256).alias("clean_sha256"))


def header_flags(spark, sf_dir):
    """What each line looks like."""
    rows = units(spark, sf_dir)
    t = F.col("text")
    return rows.select("source_doc_id", F.col("parent_paragraph_id").alias("n"), T.is_likely_header(t).alias("header"), T.looks_like_sentence(t).alias("sentence"), T.is_title(t).alias("title"), T.is_noise_header(t).alias("noise"), T.is_substantial(t).alias("substantial"), T.ends_paragraph(t).alias("ends"))


def paragraph_types(spark, sf_dir):
    """Lines by their type."""
    rows = units(spark, sf_dir).withColumn("paragraph_type", T.paragraph_type(F.col("text"), F.lit(None).cast("string")))
    return rows.groupBy("paragraph_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def char_offsets(spark, sf_dir):
    """Number and offsets of each line in its document."""
    return units(spark, sf_dir).select("source_doc_id", F.col("parent_paragraph_id").alias("n"), "char_start_in_doc", "char_end_in_doc")


def _shown(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select("source_doc_id", "chunk_index", F.size("paragraph_ids").alias("n_units"), F.element_at("paragraph_ids", 1).alias("first_unit"), "token_count_est", "char_start_in_doc", "char_end_in_doc", F.md5("text").alias("text_md5"), *more)


def chunk_small_fixed(spark, sf_dir):
    """Fixed windows."""
    return _shown(chunking.flat_chunks(units(spark, sf_dir), chunking.SMALL_FIXED))


def chunk_medium_overlap(spark, sf_dir):
    """Overlapping windows and the tokens that they share."""
    chunks = chunking.flat_chunks(units(spark, sf_dir), chunking.MEDIUM_OVERLAP)
    return _shown(chunks).join(chunks.select("source_doc_id", "chunk_index", "overlap_with_prev_tokens", "overlap_with_next_tokens"), ["source_doc_id", "chunk_index"])


def hier_parents(spark, sf_dir):
    """One parent per node with its children's number."""
    parents, _ = chunking.hierarchical_chunks(units(spark, sf_dir))
    return parents.select("source_doc_id", "chunk_id", "token_count_est", "char_count", F.size("children_ids").alias("n_children"))


def hier_children(spark, sf_dir):
    """Children within their parents."""
    _, children = chunking.hierarchical_chunks(units(spark, sf_dir))
    return _shown(children).join(children.select("source_doc_id", "chunk_index", "parent_id"), ["source_doc_id", "chunk_index"])


def row_chunks_small(spark, sf_dir):
    """G2, A3 over rows: fixed windows by jumps, no document in one row."""
    return _shown(jumps.flat_chunks(units(spark, sf_dir), chunking.SMALL_FIXED))


def row_chunks_overlap(spark, sf_dir):
    """G3, A3, W6 over rows: overlapping windows by jumps, with what neighbours share."""
    return _shown(jumps.flat_chunks(units(spark, sf_dir), chunking.MEDIUM_OVERLAP), "overlap_with_prev_tokens", "overlap_with_next_tokens")


def chunk_links(spark, sf_dir):
    """Chunks and their neighbours."""
    return chunking.flat_chunks(units(spark, sf_dir), chunking.SMALL_FIXED).select("chunk_id", "prev_chunk_id", "next_chunk_id")


def chunk_summary(spark, sf_dir):
    """Counts and tokens of the partitions."""
    return chunking.chunk_summary(chunking.chunk_corpus(windows.written(units(spark, sf_dir))), "retrieval_setting")


def structured_corpus(spark, sf_dir):
    """Whole documents through blocks, headers, paragraphs, units and all four partitions."""
    paragraphs = structure.build_paragraphs(structure.files_of_documents(documents(spark, sf_dir)))
    chunks = chunking.chunk_corpus(windows.written(chunking.build_units(paragraphs)))
    return chunks.select("chunk_id", "retrieval_setting", "parent_id", "token_count_est", "char_start_in_doc", "char_end_in_doc", F.md5("text").alias("text_md5"))


def quality_report(spark, sf_dir):
    """A5: a document's paragraphs by size."""
    rows = units(spark, sf_dir).select(F.col("source_doc_id").alias("doc_id"), F.col("parent_paragraph_id").alias("paragraph_id"), T.word_count(F.col("text")).alias("word_count"))
    return structure.quality_report(rows).withColumn("largest", F.concat_ws(",", F.col("largest").cast("array<string>")))


def tfidf_df(spark, sf_dir):
    """Terms, document frequencies and idf."""
    idf = tfidf.fit(documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id").idf
    return idf.select("term", "df", F.round("idf", 9).alias("idf"))


def tfidf_search(spark, sf_dir):
    """The best documents for each benchmark text."""
    return tfidf.search(benchmark_queries(spark, sf_dir), doc_index(spark, sf_dir), K).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"))


def tfidf_block_search(spark, sf_dir):
    """The same by blocks of postings, of which those that can't reach a query's k-th score are left out."""
    blocks = blockmax.BlockIndex.of(doc_index(spark, sf_dir))
    return blockmax.search(benchmark_queries(spark, sf_dir), blocks, K).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"))


def chunk_search(spark, sf_dir):
    """The flagship: documents to fixed windows, to an index, to the best windows for each benchmark text."""
    chunks = windows.written(chunking.flat_chunks(units(spark, sf_dir), chunking.SMALL_FIXED))
    index = retrieval.fit_partition(chunks, "small_fixed").stored()
    return tfidf.search(benchmark_queries(spark, sf_dir), index, 3).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


def hier_search(spark, sf_dir):
    """Documents as parents, their lines as children."""
    docs = documents(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = units(spark, sf_dir).select(F.col("unit_id").alias("chunk_id"), F.col("source_doc_id").alias("parent_id"), "text", "parent_paragraph_id")
    fields = {c: F.lit(None).cast("string") for c in ("source_title", "section_path_str")}
    parents = docs.withColumns(fields | {"source_doc_id": F.col("chunk_id"), "parent_id": F.lit(None).cast("string"), "retrieval_setting": F.lit("hierarchical_parent"), "chunk_index": F.lit(0)}).drop("doc_id")
    children = lines.withColumns(fields | {"source_doc_id": F.col("parent_id"), "retrieval_setting": F.lit("hierarchical_child"), "chunk_index": F.col("parent_paragraph_id")}).drop("parent_paragraph_id")
    chunks = windows.written(parents.unionByName(children))
    asked = benchmark_queries(spark, sf_dir)
    best = retrieval.search_parents(asked, chunks, index=retrieval.fit_partition(chunks, "hierarchical_parent").stored())
    hits = retrieval.rerank_children(asked, best, chunks, index=retrieval.fit_partition(chunks, "hierarchical_child").stored())
    return hits.select("query_id", "rank", "chunk_id", "parent_id", F.round("score", 9).alias("score"))


def _dense(spark, sf_dir, metric):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.search(queries, vectors, K, metric).withColumn("score", F.round("score", 9))


def dense_ip_topk(spark, sf_dir):
    """Exact inner products. Queries are the rows whose id is divisible by 100."""
    return _dense(spark, sf_dir, "ip")


def dense_l2_topk(spark, sf_dir):
    """Exact squared distances."""
    return _dense(spark, sf_dir, "l2")


def _dense_cells(spark, sf_dir, metric):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return cells.search(queries, cells.CellIndex.of(vectors), K, metric).withColumn("score", F.round("score", 9))


def dense_ip_cells(spark, sf_dir):
    """Exact inner products by cells of which those that can't matter are left out."""
    return _dense_cells(spark, sf_dir, "ip")


def dense_l2_cells(spark, sf_dir):
    """Exact squared distances by cells."""
    return _dense_cells(spark, sf_dir, "l2")


def latent_search(spark, sf_dir):
    """Documents and benchmark texts as latent vectors of the documents' index, the best documents for each text. No SQL finds singular vectors."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = latent.LatentModel.fit(doc_index(spark, sf_dir), size=24)
    asked = model.encode(benchmark_queries(spark, sf_dir), "query_id", "query", "vector")
    hits = cells.search(asked, cells.CellIndex.of(model.encode(docs, "doc_id"), "doc_id"), K)
    return hits.select("query_id", "rank", F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))


def normalized_vectors(spark, sf_dir):
    """Vectors of length one."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("size"), F.round(dense.dot(dense.normalize(F.col("embedding")), dense.normalize(F.col("embedding"))), 9).alias("norm2"))


def _windows(spark, sf_dir) -> DataFrame:
    return windows.turns_to_windows(table(spark, sf_dir, "conversations"), WINDOW_TURNS)


def window_text(spark, sf_dir):
    """Query texts of conversation windows."""
    return _windows(spark, sf_dir).select("conv_id", "window_no", "first_turn", "last_turn", F.md5("query").alias("query_md5"))


def ranged_windows(spark, sf_dir):
    """Overlapping windows as a table, one from each turn and one over everything, joined with the turns in their ranges."""
    turns = table(spark, sf_dir, "conversations")
    each = turns.select("conv_id", F.concat(F.lit("r"), F.col("turn").cast("string")).alias("window_id"), F.col("turn").cast("long").alias("start_turn"), (F.col("turn") + F.col("turn") % 4).cast("long").alias("end_turn"))
    whole = turns.select("conv_id").distinct().select("conv_id", F.lit("all").alias("window_id"), F.lit(0).cast("long").alias("start_turn"), F.lit(10**12).alias("end_turn"))
    found = windows.range_windows(each.union(whole), turns).where("query <> ''")
    return found.select("conv_id", "window_id", F.md5("query").alias("query_md5"))


def _runs(spark, sf_dir) -> DataFrame:
    """Every benchmark text with its hits among the documents, under each flat condition."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("source_title"), F.col("lang").alias("section_path_str"))
    hits = tfidf.search(benchmark_queries(spark, sf_dir), doc_index(spark, sf_dir), 3).join(docs, F.col("chunk_id") == F.col("doc_id"))
    hit = F.struct("rank", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chunk_id"), "source_title", "section_path_str", F.lit(None).cast("string").alias("parent_id"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    runs = windows.with_conditions(benchmark_queries(spark, sf_dir).join(grouped, "query_id"), ["small_fixed", "medium_overlap"])
    return runs.withColumn("parent_hits", F.slice("hits", 1, 0)).withColumn("source_file", prompts.run_file(F.concat(F.lit("q"), F.col("query_id").cast("string")), F.col("condition")))


def prompt_rows(spark, sf_dir):
    """Prompts of each query and condition."""
    return prompts.add_prompts(_runs(spark, sf_dir)).select("source_file", F.md5("user_prompt").alias("user_md5"), F.length("system_prompt").alias("system_length"))


def mock_generate(spark, sf_dir):
    """Answers of the mock generator."""
    return prompts.generate(_runs(spark, sf_dir)).select("source_file", F.regexp_extract("generated_response", r"centre on: ([^\n]*)", 1).alias("first_source"), F.regexp_extract("generated_response", r"comes from: ([^\n]*)", 1).alias("second_source"))


def top_sources(spark, sf_dir):
    """The sources of each query's first hits."""
    return _runs(spark, sf_dir).select("source_file", scoring.top_sources(F.col("hits")).alias("top_sources"))


def score_template(spark, sf_dir):
    """The sheet for raters."""
    runs = prompts.generate(_runs(spark, sf_dir))
    runs = runs.withColumns({c: F.lit(None).cast("string") for c in ("vignette_id", "window_id", "target_ifs_goal", "expected_retrieval_theme")})
    return scoring.score_template(runs).select("source_file", "condition", "query_preview", "top_sources", "ifs_adherence_score")


def _scored(spark, sf_dir) -> DataFrame:
    """Labels as scores: documents by language, with a metric missing where the document is toxic."""
    rows = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("condition"), "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "condition", (F.col("quality") * 3 + 1).cast("string").alias("ifs_adherence_score"), F.when(F.col("toxic") == 0, (F.col("n_chars") % 3).cast("string")).otherwise("").alias("grounding_score"))


def score_summary(spark, sf_dir):
    """Means by condition over the rows with both scores."""
    return scoring.score_summary(_scored(spark, sf_dir))


def auto_grade(spark, sf_dir):
    """The documents as answers to benchmark texts, graded."""
    asked = windows.written(windows.numbered(benchmark_queries(spark, sf_dir), "n", "query_id"))  # items go round
    rows = documents(spark, sf_dir).withColumn("n", (F.col("doc_id") % F.lit(max(1, asked.count()))).cast("int")).join(asked, "n", "left")
    sheet = rows.select(F.concat(F.lit("v0"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("_"), F.col("doc_id").cast("string")).alias("file"), F.col("lang").alias("condition"), "query", F.col("text").alias("generated_response"), F.concat(F.col("source"), F.lit(" ; "), F.substring("query", 1, 40)).alias("top_retrieval_sources"))
    return scoring.auto_grade(sheet).drop("query", "generated_response", "top_retrieval_sources")


def _graded(spark, sf_dir) -> DataFrame:
    """Turns as graded outputs: three turns make a window, one for each condition."""
    rows = table(spark, sf_dir, "conversations")
    n, condition = F.length("text"), F.element_at(F.array(*(F.lit(c) for c in reports.ORDER)), (F.col("turn") % 3 + 1).cast("int"))
    window = F.concat_ws("_", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 3).cast("string"))
    return rows.select(window.alias("window_id"), condition.alias("condition"), *(F.when(n % (3 + k) > 0, (n + k) % 5 + 1).cast("int").alias(m) for k, m in enumerate(scoring.METRICS)))


def metric_means(spark, sf_dir):
    """Mean metrics by condition."""
    return reports.metric_means(_graded(spark, sf_dir))


def overall_wins(spark, sf_dir):
    """Windows that each condition wins."""
    return reports.win_counts(_graded(spark, sf_dir)).drop("position")


def box_statistics(spark, sf_dir):
    """Quartiles and whiskers of the overall score."""
    found = reports.box_statistics(_graded(spark, sf_dir))
    return found.select("condition", *(F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")))


def unpivot_metrics(spark, sf_dir):
    """Metrics in long form."""
    return reports.long_form(_graded(spark, sf_dir), ["window_id", "condition"])


def duplicate_ids(spark, sf_dir):
    """Texts that several documents have, as repeated ids."""
    rows = documents(spark, sf_dir).select(F.md5(F.coalesce("text", F.lit(""))).alias("chunk_id"))
    return validation.duplicate_ids(rows)


def orphan_children(spark, sf_dir):
    """Documents without labels."""
    kids = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("parent_id"))
    return validation.orphans(kids, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))).select("chunk_id")


def embedding_report(spark, sf_dir):
    """Embedded rows by label, the first and the last by their ids."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").alias("embedding_partition"), "embedding", "vec_id")
    return validation.embedding_report(rows, row="vec_id")


QUERIES = {f.__name__: f for f in (
    word_token_stats, clean_documents, header_flags, paragraph_types, char_offsets, chunk_small_fixed, chunk_medium_overlap, row_chunks_small, row_chunks_overlap, hier_parents, hier_children, chunk_links, chunk_summary, structured_corpus,
    quality_report, tfidf_df, tfidf_search, tfidf_block_search, chunk_search, hier_search, dense_ip_topk, dense_l2_topk, dense_ip_cells, dense_l2_cells, latent_search, normalized_vectors, window_text, ranged_windows, prompt_rows, mock_generate, top_sources, score_template, score_summary,
    auto_grade, metric_means, overall_wins, box_statistics, unpivot_metrics, duplicate_ids, orphan_children, embedding_report,
)}
