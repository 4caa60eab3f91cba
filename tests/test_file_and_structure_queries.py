"""The queries of pages, structure and files against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwork.operators import cleaning, packing_folds, reports, structure
from loomwork.sources import readers
from loomwork.streaming import scores
from loomwork.structure_oracles import ORACLES
from tests.test_queries import SF, canonical

pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no tables")


@pytest.mark.parametrize("name", sorted(n for n in ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(want.columns, want.fetchall())


def test_names_of_many_digits_sort(spark):
    names = ["a2", "a10", "a010", "b" + "9" * 25, "b1" + "0" * 25, "b8", "a", "2b", "10b"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in rows.orderBy(structure.natural_order(F.col("name")), "name").collect()]
    assert got == ["2b", "10b", "a", "a2", "a010", "a10", "b8", "b" + "9" * 25, "b1" + "0" * 25]


def test_merging_small_parts(spark):
    rows = spark.createDataFrame([(["x", "long a", "y", "z", "long b", "w"],), ([],), (["q"],)], "parts array<string>")
    got = [r["m"] for r in rows.select(packing_folds.merge_small(F.col("parts"), lambda p: F.length(p) < 3).alias("m")).collect()]
    assert got == [["x", "long a y z", "long b w"], [], ["q"]]


def test_quartiles_are_interpolated(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 5.0, 9.0, 10.0)] + [("b", 3.0)], "condition string, overall double")
    got = {r["condition"]: r["q"] for r in reports.quartiles(rows, "overall").collect()}
    want = {r["condition"]: r["q"] for r in rows.groupBy("condition").agg(F.percentile("overall", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_stacked_headings_in_runs(spark):
    text = "INTRO\n\nTHE\nB IG\n  IDEA \nplain words that are no heading.\nA\nB\nlower case\n" + "X" * 39 + "\n" + "Y" * 39 + "\n" + "Z" * 39
    (got,) = spark.createDataFrame([(text,)], "t string").select(cleaning.merge_stacked_headings(F.col("t")).alias("m")).first()
    assert got.split("\n") == ["INTRO", "", "THE BIG IDEA", "plain words that are no heading.", "AB", "lower case", "X" * 39, "Y" * 39, "Z" * 39]


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = readers.spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and one.count() == 100
    many = spark.range(100).repartition(64)
    assert readers.spread(many, "id").rdd.getNumPartitions() == 64


def test_latest_summary(spark, tmp_path):
    for n, value in ((0, 1), (2, 3), (1, 2)):
        spark.range(value).write.parquet(str(tmp_path / f"batch={n}"))
    assert scores.latest(spark, str(tmp_path)).count() == 3


def test_cleaning_of_texts_without_marks_changes_nothing_else(spark):
    rows = [("Created from buffalo on x\nkept", "\nkept"), ("a\n•\nb", "a\nb"), ("  • x\no  y", "  - x\n  -  y"), ("ebook central\nnothing", "ebook central\nnothing"), (None, None), ("", "")]
    for text, want in rows:
        t = F.lit(text).cast("string")
        steps = cleaning.normalize_bullets(cleaning.remove_symbol_lines(cleaning.remove_citation_lines(cleaning.remove_footers(t))))
        assert spark.range(1).select(steps.alias("x")).first()["x"] == want
