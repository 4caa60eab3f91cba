"""Reading what a manifest names: files as a table, and ranked rules by which a manifest's entries find theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.readers import CHUNK

#: Where an entry's file may be, best first.
RULES = ("as named", "beside the manifest", "under the partition", "anywhere under the partition")


def plain_path(path: Column) -> Column:
    """A path without ``file:``, empty parts, ``.`` and ``..``; other schemes stay."""
    bare = F.regexp_replace(path, "^file:/*", "/")
    scheme = F.regexp_extract(bare, "^([a-z][a-z0-9+.-]*://)", 1)
    parts = F.filter(F.split(F.substr(bare, F.length(scheme) + 1), "/"), lambda x: ~x.isin("", "."))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    rest = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(scheme != "", scheme).when(bare.startswith("/"), "/").otherwise(""), F.array_join(rest, "/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def files(spark: SparkSession, root: str, pattern: str = "*.json*") -> DataFrame:
    """``path`` of each file below ``root``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(plain_path(F.col("path")).alias("path"))


def entries(documents: DataFrame, partitions: tuple[str, ...] = ("small_fixed", "medium_overlap", "hierarchical_parent", "hierarchical_child")) -> DataFrame:
    """``manifest, partition, name`` of manifests' documents (``manifest``, and ``outputs``: a map of partition to file).

    Plural names of partitions count as singular. A partition that no document names is an error; so is an empty manifest.
    """
    rows = documents.select("manifest", F.explode(F.map_entries("outputs")).alias("o"))
    rows = rows.select("manifest", F.regexp_replace(F.regexp_replace("o.key", "parents$", "parent"), "children$", "child").alias("partition"), F.col("o.value").alias("name")).where(F.col("partition").isin(*partitions) & F.col("name").isNotNull())
    named = {r["partition"] for r in rows.select("partition").distinct().collect()}
    for partition in partitions:
        if partition not in named:
            raise ValueError(f"the manifest names no file of partition {partition}")
    return rows


def resolve(entries: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``entries`` (``manifest, partition, name``), each once, with the ``path`` found and the ``rule`` (from 0) that found it.

    The best rule counts, of several files the smallest path. A name without a file is an error when its row is read.
    """
    asked = entries.select("manifest", "partition", "name").distinct()
    folder = F.concat_ws("/", F.lit(root), "partition")
    beside = F.when(F.col("name").rlike("^(/|[a-z][a-z0-9+.-]*:/)"), F.col("name")).otherwise(F.concat_ws("/", F.regexp_replace("manifest", "/[^/]*$", ""), "name"))
    guesses = [F.col("name"), beside, F.concat_ws("/", folder, base_name(F.col("name")))]
    guess = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), plain_path(p).alias("path")) for k, p in enumerate(guesses))))
    direct = asked.select("*", guess.alias("g")).select("manifest", "partition", "name", "g.rule", "g.path").join(files, "path", "left_semi")
    below = asked.withColumns({"_base": base_name(F.col("name")), "_folder": F.concat(plain_path(folder), F.lit("/"))})
    anywhere = below.join(files.withColumn("_base", base_name(F.col("path"))), "_base").where(F.col("path").startswith(F.col("_folder"))).withColumn("rule", F.lit(3))
    keys = ["manifest", "partition", "name"]
    best = direct.select(*keys, "rule", "path").unionByName(anywhere.select(*keys, "rule", "path")).groupBy(*keys).agg(F.min(F.struct("rule", "path")).alias("best"))
    missing = F.raise_error(F.concat(F.lit("no file for "), F.col("name"), F.lit(" of partition "), F.col("partition")))
    return asked.join(best, keys, "left").select(*keys, F.when(F.col("best").isNull(), missing).otherwise(F.col("best")).alias("best")).select(*keys, "best.rule", "best.path")


def read(spark: SparkSession, resolved: DataFrame, root: str, schema: str = CHUNK) -> DataFrame:
    """Rows of the JSON-lines files that entries resolve to, with ``source_jsonl`` and ``partition``; bad lines are an error.

    All files below ``root`` are opened by the one scan and met with the entries by path, so that no list of files passes
    through the driver.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(root).where(F.trim("value") != "")
    lines = raw.select("value", plain_path(F.col("_metadata.file_path")).alias("path"))
    parsed = lines.join(resolved.select("path", "partition").distinct(), "path").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.col("path").alias("source_jsonl"), "partition")
    names = [f.name for f in parsed.schema["r"].dataType.fields if f.name not in ("source_jsonl", "partition")]
    return parsed.select(*(F.col("r")[n].alias(n) for n in names), "source_jsonl", "partition")
