"""Score summaries of runs and sheets that keep arriving, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators.scoring import score_summary
from loomwork.sources.readers import SCORES


def sheets(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New score sheets of a folder as a stream."""
    return spark.readStream.schema(SCORES).option("header", True).option("multiLine", True).option("escape", '"').option("maxFilesPerTrigger", per_trigger).csv(path)


def summarize(scored: DataFrame) -> DataFrame:
    """The running summary by condition: the same expression as for a batch."""
    return score_summary(scored)


def window_counts(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and tumbling window; what is later than the watermark is left out."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, length), kind_col).agg(F.count("*").alias("n"))


def start(df: DataFrame, path: str, checkpoint: str, name: str = "scores") -> StreamingQuery:
    """Keep summaries as Parquet below ``path``, each batch's in a folder ``batch=<number>``: one file each: a repeated batch replaces its own, and readers never meet a half-written one."""
    return df.writeStream.outputMode("complete").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The summary of the last batch; its one file is there whole or not at all."""
    found = spark.read.parquet(path)
    last = found.agg(F.max("batch").alias("last")).first()["last"]
    return found.where(F.col("batch") == last).drop("batch")
