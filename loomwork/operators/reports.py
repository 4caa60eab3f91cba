"""Report tables: what plots of scores by condition are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import windows
from loomwork.operators.scoring import METRICS

ORDER = ["small_fixed", "medium_overlap", "hierarchical"]


def in_order(condition: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in order)), condition)


def metric_means(graded: DataFrame, metrics: list[str] = METRICS, places: int | None = 2) -> DataFrame:
    """A row per condition with the mean of each metric; nulls are left out of the means."""
    mean = lambda m: F.avg(m) if places is None else F.round(F.avg(m), places)
    return graded.groupBy("condition").agg(*(mean(m).alias(m) for m in metrics))


def overall_score(metrics: list[str] = METRICS) -> Column:
    """The mean of a row's metrics, without its nulls; null if all are."""
    known = F.filter(F.array(*(F.col(m).cast("double") for m in metrics)), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def best_conditions(graded: DataFrame, key: str = "window_id", order: list[str] = ORDER) -> DataFrame:
    """Per window the condition of the largest overall score; ties go to the earlier condition of ``order``."""
    scored = graded.withColumn("overall", overall_score())
    rank = W.partitionBy(key).orderBy(F.desc_nulls_last("overall"), in_order(F.col("condition"), order), "condition")
    return scored.withColumn("n", F.row_number().over(rank)).where("n = 1").select(key, "condition", "overall")


def win_counts(graded: DataFrame, key: str = "window_id", order: list[str] = ORDER) -> DataFrame:
    """How many windows each condition of ``order`` wins, 0 included."""
    wins = best_conditions(graded, key, order).groupBy("condition").agg(F.count("*").alias("wins"))
    listed = graded.sparkSession.createDataFrame([(c, n) for n, c in enumerate(order)], "condition string, position int")
    return listed.join(wins, "condition", "left").select("condition", "position", F.coalesce("wins", F.lit(0)).alias("wins"))


def order_statistics(scored: DataFrame, value: str, shares: tuple[float, ...], key: str = "condition") -> DataFrame:
    """``key, share, low, high, part``: the values on either side of each share's place among a key's, and how far it lies between.

    Equal values are counted first and dealt by ranges of key and value; sums of ranges tell which range holds a place, and
    only these are ranked, each by itself. No key's values gather in a task. Nulls take no part.
    """
    counts = scored.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("v")).where("v is not null").groupBy("_key", "v").agg(F.count("*").alias("n"))
    dealt = windows.stored(counts.repartitionByRange("_key", "v").withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy("_key", "_range").agg(F.sum("n").alias("_n"))
    ranges = W.partitionBy("_key").orderBy("_range")
    held = held.withColumns({"_upto": F.sum("_n").over(ranges), "_total": F.sum("_n").over(W.partitionBy("_key"))}).withColumn("_before", F.col("_upto") - F.col("_n"))
    places = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), ((F.col("_total") - 1) * s).alias("at")) for s in shares)))
    asked = held.select("*", places.alias("p")).select("_key", "_range", "_before", "_upto", "p.share", "p.at", F.explode(F.array(F.floor("p.at"), F.ceil("p.at"))).alias("place"))
    asked = asked.where("_before <= place and place < _upto").distinct()
    same = [F.col("_key").eqNullSafe(F.col("_asked")), F.col("_range") == F.col("_in")]
    cells = asked.select(F.col("_key").alias("_asked"), F.col("_range").alias("_in"), "_before").distinct()
    ranked = dealt.join(cells, same).withColumn("_to", F.col("_before") + F.sum("n").over(W.partitionBy("_key", "_range").orderBy("v")))
    ranked = ranked.select(F.col("_key").alias("_asked"), F.col("_range").alias("_in"), "v", F.col("_to") - F.col("n"), "_to").toDF("_asked", "_in", "v", "_from", "_to")
    found = asked.join(ranked, [*same, F.col("_from") <= F.col("place"), F.col("place") < F.col("_to")])
    return found.groupBy(F.col("_key").alias(key), "share", (F.col("at") - F.floor("at")).alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def quantiles(scored: DataFrame, value: str, shares: tuple[float, ...], key: str = "condition") -> DataFrame:
    """``key, share, q``: exact quantiles, interpolated between neighbours."""
    return order_statistics(scored, value, shares, key).select(key, "share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))


def quartiles(scored: DataFrame, value: str) -> DataFrame:
    """``condition, q``: the three quartiles."""
    found = quantiles(scored, value, (0.25, 0.5, 0.75))
    return found.groupBy("condition").agg(F.transform(F.sort_array(F.collect_list(F.struct("share", "q"))), lambda x: x["q"]).alias("q"))


def box_statistics(graded: DataFrame, value: str = "overall") -> DataFrame:
    """Per condition the quartiles and the whiskers' ends: the furthest values within 1.5 interquartile ranges."""
    scored = graded.withColumn("overall", overall_score()).where(F.col(value).isNotNull())
    joined = scored.select("condition", value).join(quartiles(scored, value), "condition").withColumn("reach", (F.col("q")[2] - F.col("q")[0]) * 1.5)
    inside = F.col(value).between(F.col("q")[0] - F.col("reach"), F.col("q")[2] + F.col("reach"))
    first = lambda i: F.first("q")[i]
    return joined.groupBy("condition").agg(F.min(F.when(inside, F.col(value))).alias("low"), first(0).alias("q1"), first(1).alias("median"), first(2).alias("q3"), F.max(F.when(inside, F.col(value))).alias("high"))


def long_form(graded: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """``keys, metric, value``: a row for each metric."""
    return graded.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def heatmap(graded: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Metrics down, conditions across."""
    return long_form(graded, ["condition"], metrics).groupBy("metric").pivot("condition", ORDER).agg(F.avg("value"))


def radar(means: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """``condition, metric, angle, value``: points of a polygon for each condition."""
    rows = long_form(means, ["condition"], metrics)
    position = F.array_position(F.array(*(F.lit(m) for m in metrics)), F.col("metric")) - 1
    return rows.withColumn("angle", F.pi() * 2 * position / len(metrics))


def known_metric(summary: DataFrame, metric: str) -> DataFrame:
    """Rows in which a metric is neither null nor blank."""
    return summary.where(F.col(metric).isNotNull() & (F.col(metric).cast("string") != ""))
