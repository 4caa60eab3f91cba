"""Toxicity, language ID, packing, SentencePiece, nearest neighbours and URL filters."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import language_id, packing, permutation_index, sentencepiece_codec, toxicity, url_filter


@pytest.mark.parametrize("sizes", [[5, 1, 3], [1], [2] * 9])
def test_forward_backward_is_exact(monkeypatch, sizes):
    monkeypatch.setattr(toxicity, "STEP", 4)
    rng = np.random.default_rng(sum(sizes))
    chain = toxicity.Chain(rng.normal(size=2), rng.normal(size=(2, 2)))
    emission = rng.normal(size=sum(sizes))
    first = np.concatenate([[True] + [False] * (n - 1) for n in sizes])
    got, pair = chain.run(emission, first)
    at = 0
    for n in sizes:
        weights = {}
        for tags in itertools.product((0, 1), repeat=n):
            w = chain.start[tags[0]] + sum(chain.follow[a, b] for a, b in zip(tags, tags[1:])) + sum(e for e, t in zip(emission[at : at + n], tags, strict=True) if t)
            weights[tags] = np.exp(w)
        total = sum(weights.values())
        for k in range(n):
            assert got[at + k] == pytest.approx(sum(w for t, w in weights.items() if t[k]) / total)
            if k:
                assert pair[1, at + k] == pytest.approx(sum(w for t, w in weights.items() if (t[k - 1], t[k]) == (0, 1)) / total)
        at += n


def corpus(spark, bad=("idiot", "Scum")):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(160):
        words = [rng.choice("abcdefghij") + rng.choice("klmnopq") + rng.choice("rstuv") for _ in range(40)]
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_spans(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    odd = docs.unionByName(spark.createDataFrame([(500, None), (501, ""), (502, "É you İdiot IDIOT scum."), (None, "ak!")], "doc_id long, text string")).withColumn("toxicity", F.lit(1))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(odd, model).collect()}
    assert all((got[k]["toxicity"]["score"] >= 0.5) == (k % 4 == 0) for k in range(160))
    assert all(0 <= r["toxicity"]["score"] <= 1 for r in got.values()) and got[500]["toxicity"]["spans"] == []
    spans = [got[502]["text"][s["start"] : s["end"]] for s in got[502]["toxicity"]["spans"]]
    assert "IDIOT scum" in spans
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_without_both_labels(spark):
    docs, labels = corpus(spark)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit_toxicity(docs, none)
        scores = toxicity.score_toxicity(docs.limit(3), model).select("toxicity.score").collect()
        assert all(r["score"] < 0.5 for r in scores)


def test_held_out_folds(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"))
    got = {r["doc_id"] for r in df.where(language_id.held_out()).collect()}
    assert got == {k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2}


def languages(spark):
    words = {"aa": "kata mola suri", "bb": "brød æble ørne", "cc": "слово дело мир"}
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choice(words[x].split()) for _ in range(rng.randint(1, 30))), x) for n, x in enumerate(["aa", "bb", "cc"] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_backoff(spark):
    model = language_id.fit_language_model(languages(spark))
    rows = [(1, "Kata, MOLA!"), (2, "brødene"), (3, "делом"), (4, None), (5, ""), (6, "123 ... !"), (7, "漢字"), (8, "suri " * 5000), (1, "Kata, MOLA!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("language", F.lit("clash"))
    got = [(r["doc_id"], r["language"]["lang"], r["language"]["score"]) for r in language_id.identify_languages(df, model).collect()]
    names = {k: lang for k, lang, _ in got}
    assert len(got) == 9 and [names[k] for k in (1, 2, 3, 4, 5, 6, 8)] == ["aa", "bb", "cc", "und", "und", "und", "aa"]
    assert names[7] in ("aa", "bb", "cc") and all(0 <= s <= 1 for _, _, s in got)
    assert language_id.identify_languages(df.limit(0), model).count() == 0
    empty = language_id.fit_language_model(languages(spark).limit(0))
    assert {r["language"]["lang"] for r in language_id.identify_languages(df, empty).collect()} == {"und"}


def test_backoff_prefers_words_then_longer_grams(spark):
    model = language_id.fit_language_model(languages(spark))
    words = language_id.Words(["kata katax zzzzz"])
    scores = model.score(words)[words.which]
    assert scores[0].argmax() == 0 and scores[1].argmax() == 0 and (scores[2] == 0).all()


def test_language_accuracy_on_held_out_rows(spark):
    docs = languages(spark)
    found = language_id.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.count() > 10 and found.where("lang <> lang_pred").count() == 0


@pytest.fixture(scope="module")
def bpe():
    return packing.load_byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [None, "", "a", "Hello world. It's 12 o'clock!\n\nNew — line é 漢字 \U0001f600", "x" * 9000, " " * 5000, "One sentence here. " * 3000, "no end " * 4000, "<|endoftext|> is text", "<|endoftext|><|endoftext|>", "a <|endoftext|>\n\n <|endoftext| >b", "x<|startoftext|>"]


def test_ids_are_the_tokenizers_own(bpe):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = bpe.encoder()
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for t in TEXTS[1:]:
        assert encode(t).tolist() == own.encode(t, add_special_tokens=False).ids
    assert len(encode(" " * 1_200_000)) > 0  # one library refuses this, the other takes over


def test_pieces_cover_every_id_once(spark, bpe):
    rng = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(100 + n, "Some words go here, then stop. " * rng.randint(1, 60)) for n in range(150)] + [(None, "null id"), (5, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0)).coalesce(2)
    got = packing.pack_documents(df, bpe, block=8 * packing.CAPACITY).collect()
    encode = bpe.encoder()
    for k, t in rows:
        if k == 5:
            continue
        ids = np.append(encode(t) if t else np.zeros(0, np.uint32), np.uint32(1)).astype("<u4")
        own = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == ids.tobytes() and {r["doc_tokens"] for r in own} == {len(ids)}
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces)])[:-1].tolist() and sum(n for _, n in pieces) <= packing.CAPACITY
    sizes = [sum(n for _, n in p) for p in sequences.values()]
    assert sum(packing.CAPACITY - n for n in sizes if n & (n - 1)) < 0.05 * sum(sizes)
    assert packing.pack_documents(df.limit(0), bpe).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(7)
    for _ in range(60):
        at = np.array(sorted({0, *(rng.randint(1, 200) for _ in range(40))}))
        while np.diff(at).max() > 32:
            at = np.unique(np.append(at, (at[:-1] + at[1:]) // 2))
        penalty = np.array([rng.choice((0, 4, 40)) for _ in at])

        def cost(cuts, at=at, penalty=penalty):
            where = {int(a): int(p) for a, p in zip(at, penalty, strict=True)}
            return sum((min(32 - (b - a), packing.SHORT) if (b - a) & (b - a - 1) == 0 and b - a < 32 else 32 - (b - a)) + where[b] for a, b in zip(cuts, cuts[1:]))

        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 32:
                    pad = min(32 - n, packing.SHORT) if n & (n - 1) == 0 and n < 32 else 32 - n
                    best[j] = min(best[j], best[i] + pad + int(penalty[j]))
        cuts = packing.best_cuts(at, penalty, 32)
        assert cuts[0] == 0 and cuts[-1] == at[-1] and cost(cuts) == best[-1]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


PROBES = [" a  b", "", "x", "日本語\U0001f600\n\tz", "a" * 300, "ab" * 500, "  lead", "trail  ", " nb", "the " * 5, "    ", "don't-stop.now" * 30, "x\r\ny", "\x00a"]


def test_merges_equal_the_library(pieces):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = PROBES + ["".join(rng.choice("abcde .é") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    encode, decode = sentencepiece_codec.Encoder(pieces), sentencepiece_codec.Decoder(pieces)
    for _ in range(2):  # the second time from memory
        for t, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == own.encode(t) and decode(ids.tolist()) == t


def test_viterbi_is_optimal_for_unigram_models():
    rng = random.Random(3)
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "aa"]
    model = sentencepiece_codec.PieceModel(["<unk>", *words], np.array([0.0, *(-rng.random() * 5 - 0.1 for _ in words)]), np.array([False] + [True] * len(words)), np.full(256, -1), 0)
    assert not model.merges
    encode = sentencepiece_codec.Encoder(model)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 25))) for _ in range(80)]
    for t, ids in zip(texts, encode(texts), strict=True):
        x = sentencepiece_codec.normalise(t)
        best = [0.0] + [-1e9] * len(x)
        for j in range(1, len(x) + 1):
            for i in range(j):
                s = model.scores[model.by_text[x[i:j]]] if x[i:j] in model.by_text else model.floor if j == i + 1 else -1e9
                best[j] = max(best[j], best[i] + s)
        assert sum(model.scores[k] if k else model.floor for k in ids.tolist()) == pytest.approx(best[-1])


def test_round_trip_in_spark(spark, pieces):
    df = spark.createDataFrame([(n, t) for n, t in enumerate([*PROBES, None])], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sentencepiece_codec.sentencepiece_digest(df, pieces).collect()
    assert len(got) == len(PROBES) + 1 and all(r["round_trip"] for r in got)
    assert sentencepiece_codec.encode_texts(df.limit(0), pieces).count() == 0


def brute_neighbours(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in queries:
        n = int(np.flatnonzero(ids == q)[0])
        s, other = (x * x[n]).sum(axis=1), np.flatnonzero(ids != q)
        out[q] = ids[other[np.lexsort((ids[other], -s[other]))[:k]]].tolist()
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    x[300:420] = x[0]  # copies of one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [0.0] * 15), (2080, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    small = permutation_index.Settings(least_pivots=64, cell_vectors=300, cell_queries=20)
    got = {}
    for r in permutation_index.nearest(df, F.col("vec_id") % 20 == 0, 20, settings=small).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float((x[r["vec_id"]].astype(np.float64) * x[r["query_id"]]).sum()), abs=1e-12)
    want = brute_neighbours(rows, range(0, 900, 20), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)
    assert got[300] == want[300]  # ties by id among copies


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(20 * k, [float(k + 1), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(df.union(df), F.col("vec_id") % 20 == 0, 20)
    assert got.groupBy("query_id").count().where("count = 4").count() == 5
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_all_files_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    s = permutation_index.Settings(least_pivots=40, posted=1, probed=1, reranked=0.0, at_least=1)
    got = {}
    for r in permutation_index.nearest(df, F.col("vec_id") % 50 == 0, 30, settings=s).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_neighbours(rows, range(0, 400, 50), 30)


def test_url_rules(spark):
    from loomwork.llm.queries import URL_RULES

    urls = [("HTTP://WWW.Example.COM/en/x?q#f", "allow", "www.example.com/en/"), ("http://example.com/en/", "block", "example.com/en/"), ("http://a.example.com/en/b", "block", "example.com/en/"), ("http://example.com/EN/", "allow", "com/"), ("http://notexample.com/en/", "allow", "com/"), ("http://x.net/es/a", "block", "net/es/"), ("http://x.net/de/", "allow", None), ("no scheme", "allow", None), (None, "allow", None), ("http://example.com", "allow", None), ("http://example.com?x/en/", "allow", None), ("", "allow", None), ("http://com/", "allow", "com/")]
    pages = spark.createDataFrame([(n, u) for n, (u, _, _) in enumerate(urls)] + [(0, urls[0][0])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r["verdict"], r["rule"]) == urls[r["page_id"]][1:], urls[r["page_id"]]
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_toxicity_learns_within_a_bound_of_bytes(spark):
    from loomwork.llm import toxicity

    rows = [{"_id": k, "label": k % 2, "bytes": size} for k, size in enumerate((60, 100, 50, 10, 40, 1))]
    assert toxicity._within(rows, 100) == [0, 1, 4] and toxicity._within(rows, 0) == [] and toxicity._within([], 5) == []
    words = lambda k: " ".join(f"{chr(97 + (k * 7 + j * j) % 26)}{chr(97 + (k + j * 3) % 26)}{chr(97 + k * j % 26)}" for j in range(40))
    docs = spark.createDataFrame([(k, words(k) + (" vile filth" if k % 2 else " calm water")) for k in range(60)] + [(60, "calm vile " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, label_bytes=20_000)
    got = {r["doc_id"]: r["toxicity"]["score"] >= 0.5 for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[k] == bool(k % 2) for k in range(60))
    nothing = toxicity.fit_toxicity(docs, labels, label_bytes=5)
    assert {r["toxicity"]["score"] for r in toxicity.score_toxicity(docs, nothing).collect()} != set()
