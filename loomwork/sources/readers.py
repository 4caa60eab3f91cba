"""Sources: every reader has an explicit schema and gives a lazy DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = """chunk_id string, retrieval_setting string, chunking_strategy string, source_doc_id string, source_title string, text string, book_order int, node_ids array<string>,
    primary_node_id string, source_files array<string>, source_file_indices array<int>, paragraph_ids array<int>, section_path array<string>, section_path_str string, chapter_label string,
    section_label string, subsection_label string, char_start_in_doc int, char_end_in_doc int, token_count_est int, char_count int, prev_chunk_id string, next_chunk_id string, parent_id string,
    children_ids array<string>, overlap_with_prev_tokens int, overlap_with_next_tokens int, node_type string, content_type string, target_tokens int, overlap_tokens int"""
EMBEDDED = CHUNK + ", source_jsonl string, embedding_row int, embedding_partition string, embedding array<float>"
VIGNETTE = """vignette_id string, title string, presenting_issue string, client_profile string, core_emotional_theme string, likely_parts array<string>, difficulty_level string, safety_flag string,
    transcript array<struct<turn_id:int,speaker:string,utterance:string>>, consultation_windows array<struct<window_id:string,turn_range:array<int>,target_ifs_goal:string,expected_retrieval_theme:string>>"""
SCORES = """source_file string, vignette_id string, window_id string, condition string, target_ifs_goal string, expected_retrieval_theme string, query_preview string, response_preview string, top_sources string,
    parts_language string, curiosity string, non_pathologizing string, ifs_alignment string, ifs_adherence_score string, grounding_score string, failure_notes string, reviewer string"""
HIT = "struct<rank:int,score:double,chunk_id:string,source_doc_id:string,source_title:string,section_path_str:string,parent_id:string,text:string>"
RUN = f"""created_at_utc string, dataset_name string, vignette_id string, window_id string, title string, condition string, query string, target_ifs_goal string, expected_retrieval_theme string,
    retrieval_model_name string, llm_provider string, llm_model string, retrieval struct<results:array<{HIT}>,parent_results:array<{HIT}>,child_results:array<{HIT}>>,
    prompt struct<system_prompt:string,user_prompt:string>, generated_response string"""
WORDS = "file string, page int, page_height double, x0 double, y0 double, x1 double, y1 double, token string, block_no int, line_no int, word_no int"
#: Names under which a JSON object may hold its rows.
WRAPPERS = ("rows", "chunks", "data", "items", "records", "metadata")
#: Spark's bound on the bytes of a batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PARTITIONS = {"small_fixed": "small_fixed", "medium_overlap": "medium_overlap", "hierarchical_parent": "hier_parent", "hierarchical_child": "hier_child"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all cores by a key if its files make fewer partitions than that (a small table in one row group, say); else as it is.

    Rows are put in the key's order then, so that they come in a repeatable one, as from files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key).sortWithinPartitions(key)


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt", strict: bool = False) -> DataFrame:
    """``path, source_file, text``: whole text files below ``path``. ``strict`` makes bytes that aren't UTF-8 an error, else they are replaced."""
    if strict:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
        return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), text.alias("text"))
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return raw.select(F.col("_metadata.file_path").alias("path"), file_name().alias("source_file"), F.make_valid_utf8("value").alias("text"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring lines of a file's block as one piece, each with its line end."""
    for batch in batches:
        lines = pc.binary_join_element_wise(batch.column("value"), "", "\n")
        keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True))
        edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else []
        for a, b in zip(edges, edges[1:], strict=False):
            part = lines.slice(a, b - a)
            first, last = part.offset, part.offset + len(part)
            at = memoryview(part.buffers()[1]).cast("B").cast("i")
            piece = part.buffers()[2].slice(at[first], at[last] - at[first]).to_pybytes()
            columns = [[keys[a][0]], [batch.column("length")[a].as_py()], [keys[a][1]], [batch.column("n")[a].as_py()], [pc.sum(batch.column("bytes").slice(a, b - a)).as_py() + b - a], [pc.sum(pc.utf8_length(part)).as_py()], [piece]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 5, pa.binary()), strict=True)], names=["path", "length", "start", "n", "bytes", "chars", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters and MD5 of each file whose pieces come one behind the other. The last line end counts if the file has it."""

    def row(path: str, chars: int, read: int, size: int, digest) -> pa.RecordBatch:
        ended = read == size
        if ended:
            digest.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([chars - (not ended)], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "chars", "text_md5"])

    own, chars, read, size, digest = None, 0, 0, 0, None
    for batch in batches:
        for path, length, taken, held, piece in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "bytes", "chars", "piece")), strict=True):
            if path != own:
                if digest:
                    yield row(own, chars, read, size, digest)
                own, chars, read, size, digest = path, 0, 0, length, hashlib.md5(usedforsecurity=False)
            else:
                digest.update(b"\n")  # the end of the line before
            digest.update(memoryview(piece)[:-1])
            chars, read = chars + held, read + taken
    if digest:
        yield row(own, chars, read, size, digest)


def text_digests(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``path, source_file, chars, text_md5`` of the texts that ``text_files`` gives, for files of any size.

    No text is held whole: files are read by lines, in blocks, and the pieces of a file pass in their order through one task,
    since an MD5 can't be put together from parts.
    """
    if spark.conf.get(BATCH_BYTES).lower() in ("67108864b", "64mb", "64m"):  # Spark's own bound
        spark.conf.set(BATCH_BYTES, "4m")  # pieces are of the size of a batch
    raw = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter=pattern)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.octet_length("value").cast("long").alias("bytes"), F.make_valid_utf8("value").alias("value"))
    pieces = lines.mapInArrow(_pieces, "path string, length long, start long, n long, bytes long, chars long, piece binary")
    found = pieces.repartition("path").sortWithinPartitions("path", "start", "n").mapInArrow(_digests, "path string, chars long, text_md5 string")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "chars", "text_md5")


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, content``: files for a reader of pages."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def books(files: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """Text files in the form that structuring takes: a folder is a document, its files are numbered in natural order."""
    from pyspark.sql import Window as W

    from loomwork.operators.structure import natural_order, title_case

    folder = F.element_at(F.split("path", "/"), -2)
    rows = files.select(F.lower(F.trim(folder)).alias("doc_id"), title_case(F.trim(F.translate(folder, "_", " "))).alias("doc_title"), *(c for c in files.columns if c != "path"))
    for doc, title in (titles or {}).items():
        rows = rows.withColumn("doc_title", F.when(F.col("doc_id") == doc, title).otherwise(F.col("doc_title")))
    order = W.partitionBy("doc_id").orderBy(natural_order(F.col("source_file")), "source_file")
    return rows.withColumn("source_file_index", F.row_number().over(order) - 1)


def json_lines(spark: SparkSession, paths: str | list[str], schema: str = CHUNK) -> DataFrame:
    """Rows of JSON-lines files with the file that each is from; blank lines are skipped, bad ones are an error."""
    raw = spark.read.text(paths).where(F.trim("value") != "").select("value", file_name().alias("source_jsonl"))
    parsed = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "source_jsonl")
    names = [f.name for f in parsed.schema["r"].dataType.fields if f.name != "source_jsonl"]
    return parsed.select(*(F.col("r")[n].alias(n) for n in names), "source_jsonl")


def json_rows(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """Rows of JSON files that hold a list, or an object with the list under one of the usual names."""
    raw = spark.read.text(path, wholetext=True)
    first = F.substring(F.ltrim("value"), 1, 1)
    listed = F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in WRAPPERS))
    rows = F.when(first == "[", F.col("value")).otherwise(listed)
    rows = F.when(rows.isNull(), F.raise_error(F.lit("no list of rows in the file"))).otherwise(rows)
    return raw.select(F.explode(F.from_json(rows, f"array<struct<{_as_struct(schema)}>>", {"mode": "FAILFAST"})).alias("r")).select("r.*")


def _as_struct(schema: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).simpleString()[len("struct<") : -1]


def rows_anywhere(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """JSON lines or JSON, by the file's ending."""
    return json_lines(spark, path, schema).drop("source_jsonl") if path.rstrip("/").endswith(".jsonl") else json_rows(spark, path, schema)


def vignettes(spark: SparkSession, path: str) -> DataFrame:
    """One row per vignette of a file with a top-level list ``vignettes``; without it, an error."""
    raw = spark.read.schema(f"vignettes array<struct<{_as_struct(VIGNETTE)}>>").json(path, multiLine=True)
    listed = F.when(F.col("vignettes").isNull(), F.raise_error(F.lit("no list of vignettes in the file"))).otherwise(F.col("vignettes"))
    return raw.select(F.explode(listed).alias("v")).select("v.*")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files of a folder with ``source_file`` and, as one column ``hits``, the rows that count for their condition."""
    raw = spark.read.schema(RUN).json(path, multiLine=True).withColumn("source_file", file_name())
    return raw.withColumn("hits", F.when(F.col("condition") == "hierarchical", F.col("retrieval.child_results")).otherwise(F.col("retrieval.results")))


def sheet(spark: SparkSession, path: str, schema: str = SCORES) -> DataFrame:
    """A CSV sheet with a header; quoted cells may hold line breaks."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def partition(spark: SparkSession, path: str, setting: str) -> DataFrame:
    """One retrieval setting of a partitioned table of chunks; only its folder is read."""
    if setting not in PARTITIONS:
        raise ValueError(f"unknown partition: {setting}")
    return spark.read.parquet(path).where(F.col("retrieval_setting") == setting)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Embedded chunks: vectors lie in the same rows as what they stand for."""
    return spark.read.schema(EMBEDDED).parquet(path)
