"""The encoder's vectors against numpy's singular values, and what they find against TF-IDF."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.operators import cells, latent, tfidf


def corpus(spark, n=300, topics=6):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        t = k % topics
        words = [f"t{t}w{rng.randrange(15)}" for _ in range(12)] + [f"c{rng.randrange(30)}" for _ in range(4)]
        rows.append((k, " ".join(words)))
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None)], "chunk_id long, text string").withColumn("text", F.coalesce("text", F.lit(""))).repartition(4)


def matrix(index):
    rows = index.postings.collect()
    terms = {t: k for k, t in enumerate(sorted({r["term"] for r in rows}))}
    a = np.zeros((400, len(terms)))
    for r in rows:
        a[r["chunk_id"], terms[r["term"]]] = r["weight"]
    return a, terms


def test_singular_vectors_equal_numpys(spark):
    index = tfidf.fit(corpus(spark)).stored()
    model = latent.LatentModel.fit(index, size=6, rounds=4)
    a, terms = matrix(index)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-3)
    v = np.zeros((len(terms), 6))
    for r in model.terms.collect():
        v[terms[r["term"]]] = r["vector"]
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    assert np.linalg.svd(vt[:6] @ v)[1].min() > 0.999  # the same subspace


def test_neighbours_share_topics_and_agree_with_tfidf(spark):
    docs = corpus(spark)
    index = tfidf.fit(docs).stored()
    model = latent.LatentModel.fit(index, size=6)
    vectors = model.encode(docs, "chunk_id")
    rows = {r["chunk_id"]: r["embedding"] for r in vectors.collect()}
    assert len(rows) == 302 and set(rows[300]) == {0.0} and all(abs(np.linalg.norm(v) - 1) < 1e-5 for k, v in rows.items() if k < 300)
    asked = spark.createDataFrame([(t, f"t{t}w1 t{t}w5 t{t}w9") for t in range(6)], "query_id long, query string")
    q = model.encode(asked, "query_id", "query", "vector")
    hits = cells.search(q, cells.CellIndex.of(vectors.where("chunk_id < 300"), "chunk_id"), 10)
    assert all(r["vec_id"] % 6 == r["query_id"] for r in hits.collect())
    plain = tfidf.search(asked, index, 50).withColumnRenamed("chunk_id", "vec_id")
    assert latent.share_in_common(hits, plain, ["query_id", "vec_id"]) > 0.5


def test_small_matrices_and_none(spark):
    two = tfidf.fit(spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "chunk_id long, text string")).stored()
    model = latent.LatentModel.fit(two, size=5)
    assert len(model.values) == 2 and np.allclose(model.values, 1)
    none = tfidf.fit(spark.createDataFrame([(1, "")], "chunk_id long, text string")).stored()
    model = latent.LatentModel.fit(none, size=5)
    assert len(model.values) == 0
    assert model.encode(spark.createDataFrame([(1, "alpha")], "chunk_id long, text string"), "chunk_id").first()["embedding"] == []
