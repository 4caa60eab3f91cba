"""Block-max search: the same rows as scoring everything, and blocks that are left out."""

import random

import pytest

from loomwork.operators import blockmax, tfidf


def topical(spark, n=3000, topics=60):
    """Documents of many topics, each with words of its own and some that all share."""
    rng = random.Random(7)
    rows = []
    for k in range(n):
        topic = k % topics
        words = [f"topic{topic}word{rng.randrange(12)}" for _ in range(rng.randint(3, 15))] + [f"common{rng.randrange(20)}" for _ in range(rng.randint(0, 10))]
        rows.append((k, " ".join(words) if k % 97 else ""))
    rows += [(n + k, rows[5][1]) for k in range(40)]  # ties
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(6)


@pytest.fixture(scope="module")
def index(spark):
    return tfidf.fit(topical(spark)).stored()


def asked(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"topic{k % 60}word{rng.randrange(12)}" for _ in range(4)) + " common3") for k in range(30)]
    rows += [(100, "unknown"), (101, ""), (102, "common1 common2"), (103, "topic5word1 topic6word1 topic7word2")]
    return spark.createDataFrame(rows, "query_id long, query string")


def key(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "size", "first"), [(5, 32, 4), (60, 16, 1), (1, 64, 2)])
def test_same_rows_as_scoring_everything(spark, index, k, size, first):
    blocks = blockmax.BlockIndex.of(index, size=size)
    assert key(blockmax.search(asked(spark), blocks, k, first_blocks=first)) == key(tfidf.search(asked(spark), index, k))


def test_blocks_are_skipped(spark, index):
    blocks = blockmax.BlockIndex.of(index, size=16)
    vectors = tfidf.query_vectors(asked(spark).where("query_id < 100"), index).withColumnRenamed("weight", "q")
    _, open_, all_ = blockmax.plan_blocks(vectors, blocks, 5)
    seen, there = open_.count() + 30 * blockmax.FIRST_BLOCKS, all_.count()
    assert there > 2000 and seen < 0.2 * there
    best = {(r["query_id"], r["block"]): r["bound"] for r in all_.collect()}
    place = {(r["chunk_id"]): r["block"] for r in blocks.postings.select("chunk_id", "block").distinct().collect()}
    for r in tfidf.scores(asked(spark).where("query_id < 100"), index).collect():
        assert r["score"] <= best[(r["query_id"], place[r["chunk_id"]])] + blockmax.SLACK


def test_no_queries_and_no_chunks(spark, index):
    blocks = blockmax.BlockIndex.of(index)
    assert blockmax.search(asked(spark).limit(0), blocks, 3).count() == 0
    empty = blockmax.BlockIndex.of(tfidf.fit(topical(spark).limit(0)).stored())
    assert blockmax.search(asked(spark), empty, 3).count() == 0
