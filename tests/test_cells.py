"""Dense search by cells: the same rows as comparing with everything, from a small share of clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import cells, dense


def clustered(spark, n=4000, size=16, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(40, size))
    x = middle[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, size))
    x[:200] = x[0]  # many equal vectors, ties
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)


def plain(df, ids, k, metric):
    rows = {r["vec_id"]: np.array(r["embedding"]) for r in df.where("embedding is not null").collect()}
    out = []
    for q in ids:
        score = {v: float((x * rows[q]).sum()) if metric == "ip" else float(((x - rows[q]) ** 2).sum()) for v, x in rows.items()}
        best = sorted(score, key=lambda v: (-round(score[v], 9) if metric == "ip" else round(score[v], 9), v))[:k]
        out += [(q, n + 1, round(score[v], 6)) for n, v in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [1, 7, 250])
def test_same_rows_as_comparing_with_everything(spark, metric, k):
    df = clustered(spark).unionByName(spark.createDataFrame([(10_000, None)], "vec_id long, embedding array<double>"))
    queries = df.where("vec_id % 400 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits, share = cells.search_with_share(queries, cells.CellIndex.of(df), k, metric)
    rows = hits.collect()
    assert sorted((r["query_id"], r["rank"], round(r["score"], 6)) for r in rows) == plain(df, range(0, 4000, 400), k, metric)
    want = {(r["query_id"], r["rank"]): r["vec_id"] for r in dense.search(queries, df, k, metric).collect()}
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in rows} == want
    if metric == "l2" and k == 7:
        assert share.agg(F.avg("share")).first()[0] < 0.15


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    queries = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in cells.search(queries, cells.CellIndex.of(df), 5).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 1): 2, (2, 2): 3, (2, 3): 1, (3, 1): 2, (3, 2): 3, (3, 3): 1}
    assert cells.search(queries, cells.CellIndex.of(df.limit(0)), 5).count() == 0
    assert cells.search(queries.limit(0), cells.CellIndex.of(df), 5).count() == 0
    with pytest.raises(ValueError):
        cells.search(queries, cells.CellIndex.of(df), 5, "cosine")
