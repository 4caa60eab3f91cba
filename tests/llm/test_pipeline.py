"""The pipeline's stages and registered queries on small tables."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_dedup import brute_substrings, squeeze
from tests.llm.test_language import PlainLanguages
from tests.llm.test_near_copies import kept_by_brute_force


def test_stages_on_a_small_corpus(spark, tmp_path):
    p = " ".join(f"word{k}" for k in range(40))
    base = [" ".join(f"t{n}x{k}" for k in range(120)) for n in range(4)]
    rows = [(1, base[0], "en"), (2, base[0].replace(" ", "\n"), "en"), (3, base[1] + " " + p, None), (4, base[2] + " " + p, "en"), (5, "123 456", "en"), (6, None, "en"), (7, base[3], "en"), (8, "short one", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept, left = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, kept, "").write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        left[name] = {r["doc_id"]: r for r in kept.collect()}
    assert set(left["language_id"]) == {1, 2, 3, 4, 7, 8} and left["language_id"][3]["lang"] == "en"
    assert set(left["exact_dedup"]) == {1, 3, 4, 7, 8} and set(left["simhash"]) == set(left["exact_dedup"])
    assert left["substring_dedup"][4]["text"] == base[2] and left["substring_dedup"][3]["text"] == rows[2][1] and left["substring_dedup"][4]["n_chars"] == len(base[2])
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).select("doc_id").distinct().count() == 5


def test_pipeline_matches_brute_force_at_the_similarity(spark):
    """The same five stages in plain Python over whole documents, near copies by every pair's similarity of 0.8 over five words."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = PlainLanguages([(t, labels[k]) for k, t in docs if t is not None and labels[k] is not None])
    docs = [(k, t) for k, t in docs if t and plain.predict(t)[0] != "und" and plain.predict(t)[1] >= 0.5]
    best = {}
    for k, t in docs:
        best[squeeze(t)] = min(best.get(squeeze(t), (1, 0)), (-len(t), k))
    docs = [(k, t) for k, t in docs if best[squeeze(t)] == (-len(t), k)]
    kept = kept_by_brute_force(docs)  # every pair of a Jaccard similarity of 0.8 over five words is a link
    docs = [d for d in docs if d[0] in kept]
    cut = brute_substrings(docs, 20)
    docs = [(k, t if cut[k][1] == 0 else cut[k][2]) for k, t in docs if cut[k][1] == 0 or cut[k][1] < cut[k][0]]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in got} == {k for k, _ in docs}
    for k, t in docs:
        tokens = np.array([*own.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        mine = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist() and {r["doc_tokens"] for r in mine} == {len(tokens)}
        assert all(zlib.crc32(tokens[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine) and sum(r["length"] for r in mine) == len(tokens)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op9_exact_dedup", "op10_url_filter", "op7_substring_dedup", "op11_centroid_clustering", "op12_document_fingerprints", "op13_source_divergence"])
def test_ops_match_sql(spark, name, tmp_path):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    names = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want))
