"""Lexical and dense retrieval against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions.words import STOP_WORDS
from loomwork.operators import dense, retrieval, tfidf

TEXTS = ["the cat sat on the mat", "dogs and cats living together", "cat cat cat", "nothing here", "the cat sat on the mat", "a mat for dogs"]


def brute(texts, query):
    toks = lambda t: [w for w in re.findall(r"\w\w+", t.lower()) if w not in STOP_WORDS]
    df = Counter(w for t in texts for w in set(toks(t)))
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(t):
        v = {w: n * idf[w] for w, n in Counter(toks(t)).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    q = vector(query)
    scores = [sum(q.get(w, 0) * x for w, x in vector(t).items()) for t in texts]
    return sorted(range(len(texts)), key=lambda k: (-round(scores[k], 12), k)), scores


@pytest.mark.parametrize("query", ["cat on a mat", "dogs", "zebra unknown", ""])
def test_tfidf_matches_plain_python(spark, query):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id int, text string")
    index = tfidf.fit(chunks)
    got = tfidf.search(spark.createDataFrame([(1, query)], "query_id int, query string"), index, 4).orderBy("rank").collect()
    order, scores = brute(TEXTS, query)
    assert [r["chunk_id"] for r in got] == order[:4] and [r["rank"] for r in got] == [1, 2, 3, 4]
    assert [r["score"] for r in got] == pytest.approx([scores[k] for k in order[:4]])


def test_index_survives_saving_and_small_corpora(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "only one")], "chunk_id int, text string")
    index = tfidf.fit(chunks).saved(str(tmp_path / "index"))
    assert tfidf.search(spark.createDataFrame([(1, "one")], "query_id int, query string"), index, 5).count() == 1


def chunk_table(spark):
    rows = [(f"p{k}", "hierarchical_parent", f"d{k}", k, None, t) for k, t in enumerate(TEXTS)]
    rows += [(f"c{k}{n}", "hierarchical_child", f"d{k}", n, f"p{k}", w) for k, t in enumerate(TEXTS) for n, w in enumerate((t, *t.split()[:3]))]
    rows += [(f"s{k}", s, f"d{k}", 0, None, t) for s in ("small_fixed", "medium_overlap") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "chunk_id string, retrieval_setting string, source_doc_id string, chunk_index int, parent_id string, text string")
    return df.withColumns({"source_title": F.concat(F.lit("T"), "source_doc_id"), "section_path_str": F.lit("S")})


def test_hierarchical_keeps_two_of_each_parent(spark):
    q = spark.createDataFrame([(1, "cat mat")], "query_id int, query string")
    parents, hits = retrieval.hierarchical_retrieve(q, chunk_table(spark))
    got = hits.orderBy("rank").collect()
    assert parents.count() == 3 and len(got) == 5
    assert max(Counter(r["parent_id"] for r in got).values()) <= 2 and {r["parent_id"] for r in got} <= {r["chunk_id"] for r in parents.collect()}
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_conditions(spark):
    q = spark.createDataFrame([(1, "cat mat"), (2, "zzz")], "query_id int, query string")
    got = retrieval.compare_conditions(q, chunk_table(spark)).collect()
    assert Counter(r["condition"] for r in got) == {c: 2 for c in retrieval.CONDITIONS}
    assert all(len(r["hits"]) == (5 if r["condition"] == "hierarchical" else 3) for r in got)
    with pytest.raises(ValueError):
        retrieval.resolve_conditions("other")


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_dense_matches_numpy(spark, metric, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(dense, "BLOCK_VECTORS", 20)
    x = np.random.default_rng(0).integers(-3, 4, (90, 5)).astype(np.float32)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = dense.search(q, v, 6, metric).orderBy("query_id", "rank").collect()
    for n in range(7):
        s = x.astype(float) @ x[n] if metric == "ip" else -((x.astype(float) - x[n]) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(90), -s))[:6]
        assert [r["vec_id"] for r in got if r["query_id"] == n] == want.tolist()


def test_embedding(spark):
    df = dense.embed(spark.createDataFrame([("some words",), ("other words",)], "text string"))
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in df.collect())
    with pytest.raises(Exception, match="empty"):
        dense.embed(spark.createDataFrame([(" ",)], "text string")).collect()
    assert spark.range(1).select(dense.with_prefix(F.lit("x"), "some-bge-model", "p: ")).first()[0] == "p: x"


def test_signed_counts_that_cancel_leave_a_unit_vector(spark):
    """Two terms of one place and opposite signs add up to nothing; the text still has a direction, and one without terms has none."""
    texts = [(f"ab{k} cd{k}",) for k in range(2000)] + [("! ?",)]
    v = dense.hashed_embedding(F.col("text"))
    plain = dense.dot(v, v)
    got = {r["text"]: r["n"] for r in spark.createDataFrame(texts, "text string").select("text", F.round(plain, 9).alias("n")).collect()}
    assert got.pop("! ?") == 0.0 and set(got.values()) == {1.0}
