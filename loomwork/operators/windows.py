"""Conversations to consultation windows: query texts from ranges of turns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions.text import strip


def check(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error with ``message`` where the condition doesn't hold (null counts as not)."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def turn_text(turns: Column) -> Column:
    """``speaker: utterance`` lines in the order of the list; turns without an utterance are left out."""
    line = lambda t: F.concat(strip(F.coalesce(t["speaker"], F.lit("Unknown"))), F.lit(": "), strip(F.coalesce(t["utterance"], F.lit(""))))
    return F.array_join(F.transform(F.filter(turns, lambda t: strip(F.coalesce(t["utterance"], F.lit(""))) != ""), line), "\n")


def window_texts(vignettes: DataFrame) -> DataFrame:
    """One row per consultation window of each vignette with its query text and slug; the vignette's columns stay.

    A turn range must be two numbers in order, and take in a turn with an utterance; anything else is an error.
    """
    rows = vignettes.select("*", F.explode("consultation_windows").alias("w")).drop("consultation_windows")
    span = F.col("w.turn_range")
    valid = (F.size(span) == 2) & (F.get(span, F.lit(0)) <= F.get(span, F.lit(1)))
    rows = rows.withColumn("turn_range", check(valid, "turn_range must be [start, end]", span))
    text = turn_text(F.filter("transcript", lambda t: t["turn_id"].between(F.col("turn_range")[0], F.col("turn_range")[1])))
    rows = rows.withColumn("query", text)
    rows = rows.withColumn("query", check(F.col("query") != "", "no utterance lies in the window", F.col("query")))
    kept = [c for c in vignettes.columns if c not in ("consultation_windows", "transcript")]
    return rows.select(*kept, F.col("w.window_id").alias("window_id"), "turn_range", F.col("w.target_ifs_goal").alias("target_ifs_goal"), F.col("w.expected_retrieval_theme").alias("expected_retrieval_theme"), "query", F.concat_ws("__", F.lower("vignette_id"), F.lower("w.window_id")).alias("slug"))


def turns_to_windows(turns: DataFrame, size: int, key: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Flat turns as windows of ``size`` turns: ``key, window_no, first_turn, last_turn, query``; windows without text are left out."""
    number = F.floor(F.col(order) / size).cast("int")
    turn = F.struct(F.col(order).alias("turn_id"), F.col(speaker).alias("speaker"), F.col(text).alias("utterance"))
    grouped = turns.groupBy(key, number.alias("window_no")).agg(F.sort_array(F.collect_list(turn)).alias("t"), F.min(order).alias("first_turn"), F.max(order).alias("last_turn"))
    return grouped.select(key, "window_no", "first_turn", "last_turn", turn_text(F.col("t")).alias("query")).where("query <> ''")


def in_ranges(windows: DataFrame, turns: DataFrame, key: str = "conv_id", order: str = "turn", width: int = 16) -> DataFrame:
    """The turns that lie in each window (key, ``window_id, start_turn, end_turn``): all columns of ``turns`` and the window's ``window_id``.

    Turns are put into bins of ``width`` numbers and windows into all bins that they reach, so that both meet by key and
    bin; the range is checked then. Windows end with their key's turns before, so that one of any length makes no more
    bins than there are. Windows may overlap; null keys and bounds match nothing.
    """
    ends = turns.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    bin_of = lambda c: F.floor(c / width)
    reach = windows.join(ends, F.col(key) == F.col("_key")).select(F.col(key).alias("_key"), "window_id", "start_turn", "end_turn", F.greatest("start_turn", "_low").alias("_from"), F.least("end_turn", "_high").alias("_to"))
    reach = reach.where("start_turn is not null and end_turn is not null and _from <= _to").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(F.col("_to"))))).drop("_from", "_to")
    placed = turns.withColumn("_at", bin_of(F.col(order)))
    joined = placed.join(reach, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")))
    return joined.where(F.col(order).between(F.col("start_turn"), F.col("end_turn"))).select(*turns.columns, "window_id")


def range_windows(windows: DataFrame, turns: DataFrame, key: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """The query text of windows given as a table: ``key, window_id, query``; windows without a turn have no row."""
    turn = F.struct(F.col(order).alias("turn_id"), F.col(speaker).alias("speaker"), F.col(text).alias("utterance"))
    joined = in_ranges(windows, turns.select(key, order, speaker, text), key, order)
    return joined.groupBy(key, "window_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select(key, "window_id", turn_text(F.col("t")).alias("query"))


def one(df: DataFrame, **ids: str) -> DataFrame:
    """The rows with these ids; none at all is an error."""
    found = df
    for column, value in ids.items():
        found = found.where(F.col(column) == value)
    if found.isEmpty():
        raise ValueError(f"no row has {ids}")
    return found


def with_conditions(windows: DataFrame, conditions: list[str]) -> DataFrame:
    """Each window once for each condition."""
    return windows.withColumn("condition", F.explode(F.array(*(F.lit(c) for c in conditions))))


#: Whether Spark drops an execution's shuffle files at its end.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; a temporary one serves local masters only.

    Unless the session says otherwise, Spark is told to drop shuffle files when what they were for is done. Else those of each
    table that was written lie beside it until the driver happens to collect its garbage; a plan that needs them again makes them anew.
    """
    if spark.conf.get(DROPPED, None) is None:
        spark.conf.set(DROPPED, "true")
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return folder or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` from reliable storage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` from Parquet in the shared folder, for rows that several parts of a plan read."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, into: str, *order: str, key: str | None = None) -> DataFrame:
    """Row numbers from 0 in the given order, of each key or of all rows; the same at every size.

    Rows are dealt by ranges of key and order, so that no key lies whole in one task; what is summed up is one row for each range and key in it.
    """
    keys = [key] if key else []
    dealt = stored(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    held = dealt.groupBy("_range", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("_range").alias("_of"), *(F.col(k).alias("_key") for k in keys), (before - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_of")
    if key:
        same = same & F.col(key).eqNullSafe(F.col("_key"))
    return dealt.join(held, same).select(*df.columns, (F.col("_at") + F.col("_shift")).cast("int").alias(into))
