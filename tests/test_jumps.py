"""Windows over rows: the same chunks as the folds over whole documents, in documents of any length."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import chunking, jumps
from loomwork.operators.chunking import ChunkSetting
from loomwork.operators.packing_folds import overlapping_ranges

SETTINGS = [ChunkSetting("plain", "a", 30, 10), ChunkSetting("shared", "b", 30, 10, 12), ChunkSetting("least", "c", 5, 40), ChunkSetting("wide", "d", 20, 5, 50)]


def plain(tokens, s):
    if s.overlap_tokens:
        return overlapping_ranges(tokens, s.target_tokens, s.overlap_tokens, s.min_tokens)
    found, start, total = [], 0, 0
    for k, t in enumerate(tokens):
        if k > start and total + t > s.target_tokens and total >= s.min_tokens:
            found.append((start, k))
            start, total = k, 0
        total += t
    return [*found, (start, len(tokens))] if tokens else []


@pytest.mark.parametrize("s", SETTINGS, ids=lambda s: s.name)
def test_ranges_match_the_plain_loop(spark, s):
    rng = random.Random(s.target_tokens + s.overlap_tokens)
    docs = {f"d{n}": [rng.choice([1, 2, 3, 8, 15, 31, 400 if n % 3 == 0 else 9]) for _ in range(size)] for n, size in enumerate((1, 2, 7, 60, 400, 401))}
    rows = spark.createDataFrame([(d, k, t) for d, ts in docs.items() for k, t in enumerate(ts)], "source_doc_id string, n int, token_count_est int").repartition(5)
    got = {}
    for r in jumps.ranges(jumps.placed(rows, "source_doc_id", "n"), s, block_windows=2).orderBy("source_doc_id", "chunk_index").collect():
        got.setdefault(r["source_doc_id"], []).append((r["start"], r["stop"]))
        assert r["tokens_to"] - r["tokens_before"] == sum(docs[r["source_doc_id"]][r["start"] : r["stop"]])
    assert got == {d: plain(ts, s) for d, ts in docs.items()}
    assert jumps.ranges(jumps.placed(rows.limit(0), "source_doc_id", "n"), s).count() == 0


@pytest.mark.parametrize("s", [chunking.SMALL_FIXED, chunking.MEDIUM_OVERLAP], ids=lambda s: s.name)
def test_chunks_match_the_fold(spark, s):
    from loomwork.queries import units

    rows = units(spark, "/root/testdata/sf0.001").cache()
    got, want = jumps.flat_chunks(rows, s, block_windows=1), chunking.flat_chunks(rows, s)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*(F.col(c).cast(got.schema[c].dataType) for c in want.columns)).collect()))


def test_a_document_of_a_million_units(spark):
    n, s = 1_000_000, ChunkSetting("m", "m", 900, 300, 180)
    rows = spark.range(n, numPartitions=8).select(F.lit("d").alias("source_doc_id"), "id", (1 + F.pmod("id", F.lit(97)) * F.pmod("id", F.lit(5))).cast("int").alias("token_count_est"))
    got = jumps.ranges(jumps.placed(rows, "source_doc_id", "id"), s).orderBy("chunk_index").select("start", "stop").toArrow()
    want = overlapping_ranges([1 + k % 97 * (k % 5) for k in range(n)], s.target_tokens, s.overlap_tokens, s.min_tokens)
    assert list(zip(got["start"].to_pylist(), got["stop"].to_pylist(), strict=True)) == want
