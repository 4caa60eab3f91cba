"""Row numbers over ranges, and the places of documents that are made of them."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import windows
from loomwork.plans import corpus
from loomwork.queries import QUERIES


def test_book_order_of_many_documents(spark):
    chunks = spark.range(100_003).select(F.format_string("d%06d", "id").alias("source_doc_id"), "id").repartition(7)
    got = corpus.with_book_order(chunks)
    assert dict(got.dtypes)["book_order"] == "int" and got.where("book_order is null or book_order <> id").count() == 0 and got.count() == 100_003


def test_numbers_match_a_window(spark):
    rng = random.Random(2)
    order = rng.sample(range(10_000), 3_000)
    rows = spark.createDataFrame([(rng.choice(["a", "a", "a", "b", None]), n, f"t{n}") for n in order], "k string, n int, t string").repartition(5)
    for key in (None, "k"):
        want = rows.withColumn("r", F.row_number().over((W.partitionBy(key) if key else W.partitionBy(F.lit(1))).orderBy("n")) - 1)
        got = windows.numbered(rows, "r", "n", key=key)
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert windows.numbered(rows.limit(0), "r", "n").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_of_vectors_deals_no_rows_by_label(spark):
    assert "Window" not in plan(QUERIES["embedding_report"](spark, "/root/testdata/sf0.001"))


def test_embedded_rows_are_numbered_in_ranges(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(f"d{n % 7}", n, "small_fixed" if n % 4 else "medium_overlap", f"text {n}") for n in range(200)], "source_doc_id string, chunk_index int, retrieval_setting string, text string").repartition(3)
    seen = []
    monkeypatch.setattr(corpus.sinks, "write_partitions", lambda df, path: (seen.append(plan(df)), df.write.parquet(path)))
    got = corpus.embed(chunks, str(tmp_path / "e")).drop("embedding", "embedding_partition")
    want = chunks.withColumn("embedding_row", F.row_number().over(W.partitionBy("retrieval_setting").orderBy("source_doc_id", "chunk_index")) - 1)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert "row_number" not in seen[0]
