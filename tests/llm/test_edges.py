"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import exact_dedup, language_id, line_dedup, near_copies, packing, permutation_index, sentencepiece_codec, simhash, substring_dedup, toxicity, url_filter
from loomwork.llm.shared import SpanHasher, free_names, mix, span_hashes

TEMPORARY = ("_key", "_order", "_text", "_covered", "_found", "_gone", "_stays", "keep_length", "order", "node", "row")
NEW = {
    "exact": (exact_dedup.exact_dedup, ("text_sha256", "keep_id", "group_size", "kept")),
    "lines": (line_dedup.line_dedup, ("n_lines", "n_removed")),
    "substrings": (substring_dedup.substring_dedup, ("n_words", "n_removed", "kept_text")),
    "simhash": (simhash.near_duplicates, ("kept",)),
    "near_copies": (near_copies.near_copies, ("kept",)),
}
LONG = "\n".join(f"line {k} of a very long text" for k in range(20_000))
ROWS = [(1, "same words here"), (1, "same words here"), (2, "same words here"), (None, None), (None, None), (3, ""), (4, None), (5, LONG), (6, LONG), (7, " \n\t")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", NEW)
def test_all_rows_and_columns_stay(spark, name):
    run, new = NEW[name]
    df = docs(spark).withColumns({c: F.lit(f"mine {c}") for c in (*TEMPORARY, *new)})
    got = run(df)
    assert set(got.columns) == set(df.columns) and got.count() == len(ROWS)
    for r in got.collect():
        assert all(r[c] == f"mine {c}" for c in TEMPORARY if c not in new)
        assert not any(r[c] == f"mine {c}" for c in new)
    none = run(df.limit(0))
    assert none.count() == 0 and set(none.columns) == set(df.columns)


@pytest.mark.parametrize("name", ["exact", "simhash", "near_copies"])
def test_ties_and_repeated_rows(spark, name):
    kept = {}
    for r in NEW[name][0](docs(spark)).collect():
        kept.setdefault((r["doc_id"], r["text"]), set()).add(r["kept"])
    assert all(len(v) == 1 for v in kept.values())  # rows that repeat an id and a text stay or go together
    assert kept[(1, "same words here")] == {True} and kept[(2, "same words here")] == {False}
    assert kept[(5, LONG)] == {True} and kept[(6, LONG)] == {False}


def test_a_document_of_half_a_million_lines(spark):
    lines = [f"{k % 100_000} {k % 7}" for k in range(500_000)]
    text = "\n".join(lines)
    (got,) = line_dedup.line_dedup(docs(spark, [(1, text)])).collect()
    seen, gone = {}, set()
    for p in range(len(lines) - 2):
        if seen.setdefault(tuple(lines[p : p + 3]), p) < p:
            gone |= {p, p + 1, p + 2}
    assert got["n_lines"] == len(lines) and got["n_removed"] == len(gone)
    assert got["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_stages_keep_the_columns_of_documents(spark):
    df = docs(spark).selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars", "1 kept", "2 _language", "3 _key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, df.limit(0), "").count() == 0
    assert corpus_pipeline.packing(spark, df.limit(0), "").count() == 0


def test_columns_that_are_added_replace_and_rows_stay(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs(spark), labels)
    languages = language_id.fit_language_model(docs(spark).withColumn("lang", F.lit("en")))
    pieces = sentencepiece_codec.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    df = docs(spark).withColumns({c: F.lit("mine") for c in ("toxicity", "language", "ids", "_key")})
    for got, new in ((toxicity.score_toxicity(df, model), "toxicity"), (language_id.identify_languages(df, languages), "language"), (sentencepiece_codec.encode_texts(df, pieces), "ids")):
        rows = got.collect()
        assert len(rows) == len(ROWS) and set(got.columns) == set(df.columns) and all(r[new] != "mine" and r["_key"] == "mine" for r in rows)
        by_text = {}
        for r in rows:
            by_text.setdefault(r["text"], set()).add(str(r[new]))
        assert all(len(v) == 1 for v in by_text.values())


def test_packing_of_long_and_repeated_texts(spark):
    bpe = packing.load_byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs(spark).withColumn("offset", F.lit("x")), bpe).collect()
    tokens = {}
    for r in got:
        tokens[(r["doc_id"], r["doc_tokens"])] = tokens.get((r["doc_id"], r["doc_tokens"]), 0) + r["length"]
    assert sum(tokens.values()) == sum(r["length"] for r in got) and tokens[(None, 1)] == 2  # two rows of null id and text
    assert all(total % size == 0 for (_, size), total in tokens.items())


def test_neighbours_of_odd_vectors(spark):
    rows = [(20, [1.0, 0.0]), (40, [1e-170, 0.0]), (60, [0.0, 0.0]), (80, None), (100, [1.0, None]), (120, [2.0]), (7, [0.5, 0.5, 9.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (140, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine"))
    got = {}
    for r in permutation_index.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    # a shorter vector counts as if zeros followed; the tiny one takes part, though its square is zero
    assert got == {20: [(120, 2.0), (7, 0.5), (40, 1e-170)], 40: [(120, 2e-170), (20, 1e-170), (7, 5e-171)], 120: [(20, 2.0), (7, 1.0), (40, 2e-170)]}


def test_long_urls_and_null_ids(spark):
    from loomwork.llm.queries import URL_RULES

    urls = ["http://" + "a." * 200_000 + "example.com/en/x", "http://example.com/en/" + "z/" * 200_000, None, None]
    pages = spark.createDataFrame([(None if k > 1 else k, u) for k, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'mine' rule", "'mine' host", "'mine' best")
    got = url_filter.filter_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect()
    assert sorted((r["page_id"] is None, r["rule"] or "") for r in got) == [(False, "example.com/en/")] * 2 + [(True, "")] * 2


def test_many_rules_pass_the_bloom_filter_exactly(spark):
    rules = spark.range(5000).selectExpr("concat('h', id, '.com') host", "if(id % 2 = 0, '/', '/a/') path", "if(id % 3 = 0, 'allow', 'block') verdict")
    pages = spark.range(12_000).selectExpr("id page_id", "concat('http://x.h', id, '.com/', if(id % 5 = 0, 'a/b', 'c')) url")
    for r in url_filter.filter_urls(pages, rules).collect():
        k = r["page_id"]
        path = "/" if k % 2 == 0 else "/a/"
        listed = k < 5000 and (path == "/" or k % 5 == 0)
        assert (r["rule"], r["verdict"]) == ((f"h{k}.com{path}", "allow" if k % 3 == 0 else "block") if listed else (None, "allow"))


def thue_morse(size, start):
    return [97 + (start + k.bit_count()) % 2 for k in range(size)]


def test_hashes_tell_words_apart_that_fool_powers_of_two():
    for size in (1024, 2048, 4096):
        data = np.array(thue_morse(size, 0) + thue_morse(size, 1), dtype=np.uint8)
        for seed in (0, 1):
            a, b = span_hashes(data, np.array([0, size]), np.array([size, 2 * size]), seed)
            assert a != b


def test_span_hashes_are_the_polynomials():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 256, 50_000).astype(np.uint8), rng.integers(0, 2**64, 40_000, dtype=np.uint64)):
        values[30_000:30_100] = values[:100]
        hasher = SpanHasher(values)
        a, b = hasher(np.array([0, 5, 16_380]), np.array([100, 90, 16_390])), hasher(np.array([30_000, 30_005, 0]), np.array([30_100, 30_090, 10]))
        assert (a[:2] == b[:2]).all() and a[2] != b[2]
        assert len(np.unique(hasher(np.arange(30_000), np.arange(30_000) + 8))) == 30_000 or values.dtype == np.uint8


def test_free_names(spark):
    df = spark.range(1).selectExpr("id _KEY", "id _key_2")
    assert free_names(df, "_key", "_x") == ["_key_", "_x"]


def plain_place(kind, hashed):
    return int(mix(np.array([hashed], dtype=np.uint64) + np.uint64(kind))[0]) % (toxicity.TABLE - 8) + 8


def plain_scores(model, text):
    """The score of one text: words by a pattern, features one by one, forward-backward over all paths' sums in plain numbers."""
    words = re.findall(rb"(?:[0-9A-Za-z]|[\x80-\xff])+", toxicity._lower(text))
    if not words:
        return 1 / (1 + math.exp(-model.scale[0]))

    def hashed(piece):
        data = np.frombuffer(piece, dtype=np.uint8)
        return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])

    emission = []
    for k, w in enumerate(words):
        places = [plain_place(0, hashed(w))] + [plain_place(n, hashed(w[:n])) if len(w) >= n else 0 for n in toxicity.PREFIXES]
        places += [plain_place(16 + n, hashed(w[-n:])) if len(w) >= n else 0 for n in toxicity.SUFFIXES]
        places.append(plain_place(32, hashed(words[k - 1])) if k else 1)
        places.append(plain_place(33, hashed(words[k + 1])) if k + 1 < len(words) else 2)
        emission.append(float(model.weights[places].sum(dtype=np.float64)))
    node = [(1.0, math.exp(e)) for e in emission]
    start, follow = np.exp(model.chain.start), np.exp(model.chain.follow)
    ahead = [[start[j] * node[0][j] for j in (0, 1)]]
    for n in node[1:]:
        ahead.append([sum(ahead[-1][i] * follow[i, j] for i in (0, 1)) * n[j] for j in (0, 1)])
    behind = [[1.0, 1.0]]
    for n in node[:0:-1]:
        behind.append([sum(follow[i, j] * n[j] * behind[-1][j] for j in (0, 1)) for i in (0, 1)])
    p = []
    for a, b in zip(ahead, behind[::-1], strict=True):
        p.append(a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]))
    x = np.array([1, max(p), math.log1p(sum(v for v in p if v >= 0.2))])
    return 1 / (1 + math.exp(-float(x @ model.scale)))


def test_toxicity_scores_equal_a_plain_version(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = language_id.held_out(folds=5, fold=0)
    model = toxicity.fit_toxicity(table.where(~out), labels.where(~out))
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(table, labels).collect()}
    rows = table.collect()
    assert set(got) == {r["doc_id"] for r in rows}
    for r in rows[:60]:
        assert got[r["doc_id"]]["score"] == pytest.approx(plain_scores(model, r["text"] or ""), abs=1e-6)
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.5)


def test_held_out_labels_are_never_learned(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = language_id.held_out(folds=5, fold=0)
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: (r["score"], r["held_out"]) for r in toxicity.toxicity_digest(table, x).collect()} for x in (labels, turned))
    assert a == b and any(h for _, h in a.values())


def test_long_labelled_texts_are_learned_from(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(6000)) + (" vilest" if k % 2 else " mildest")) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(table, table.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic"))
    probe = spark.createDataFrame([(1, "the vilest thing"), (2, "the mildest thing")], "doc_id long, text string")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(probe, model).collect()}
    assert got[1]["score"] > got[2]["score"] and [s["start"] for s in got[1]["spans"]] == [4]
