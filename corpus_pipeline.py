"""A corpus pipeline of five stages over ``documents``.

Each stage works on all that the one before it kept; what is written between them is Parquet in the shared folder that
``spark.checkpoint.dir`` names. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.exact_dedup import exact_dedup
from loomwork.llm.language_id import UNDETERMINED, fit_language_model, identify_languages
from loomwork.llm.near_copies import near_copies
from loomwork.llm.packing import packing_digest
from loomwork.llm.queries import byte_bpe, documents
from loomwork.llm.shared import shared_folder
from loomwork.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express the first stage's model, the shingle hashes or the last stage's token ids.
ORACLE_SQL = None


#: What the language found must have of all languages' shares, lest the document is rejected as doubtful.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one language, which becomes their ``lang``, whatever their label says; those without a letter or of a doubtful language go."""
    docs = docs.select(*COLUMNS)
    found = identify_languages(docs, fit_language_model(docs), into="_language")
    found = found.where((F.col("_language.lang") != UNDETERMINED) & (F.col("_language.score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("_language.lang")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest original, then the smallest id; null texts count as empty, null ids come last, rows that repeat an id and a text stay or go together."""
    return exact_dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: SimHash finds pairs, a Jaccard similarity of 0.8 over five-word shingles decides."""
    return near_copies(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; those of which nothing is left go, unchanged ones keep their layout.

    Null texts and those without words stay as they are; null ids come first, and of rows that repeat an id and a text the later ones lose what they repeat.
    """
    found = substring_dedup(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences; null texts count as empty ones (one token, the end), repeated rows are packed each, an empty table gives no piece."""
    return packing_digest(docs, byte_bpe())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", simhash), ("substring_dedup", substring), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``, each written as Parquet and reread as the next one's input."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
