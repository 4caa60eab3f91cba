"""Exact quantiles by ranges against the built-in ones."""

from pyspark.sql import functions as F

from loomwork.operators import reports

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def same(spark, df):
    got = {(r["condition"], r["share"]): r["q"] for r in reports.quantiles(df, "x", SHARES).collect()}
    want = {(r["condition"], s): q for r in df.where("x is not null").groupBy("condition").agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).collect() for s, q in zip(SHARES, r["q"], strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    return got


def test_many_distinct_values_of_one_condition(spark):
    df = spark.range(2_000_000, numPartitions=8).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("condition"), (F.xxhash64("id") / 1e12).alias("x"))
    assert len(same(spark, df)) == 14
    counts = df.groupBy("condition", "x").count().repartitionByRange("condition", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 1 and max(r["count"] for r in counts) < 1_500_000  # several tasks share the common condition


def test_ties_nulls_and_few_values(spark):
    rows = [("a", 1.0)] * 7 + [("a", 2.0)] * 3 + [("b", 5.0), ("c", None), (None, 1.0), (None, 4.0), ("d", -1.0), ("d", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "condition string, x double")
    got = same(spark, df)
    assert ("c", 0.5) not in got and got[None, 0.5] == 2.5 and got["b", 0.1] == 5.0
    assert reports.quantiles(df.limit(0), "x", SHARES).count() == 0
