"""Language identification against a plain version with dictionaries, from texts to shares."""

import math
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from loomwork.llm import language_id


class PlainLanguages:
    """Word-first backoff over dictionaries of strings."""

    def __init__(self, rows):
        self.langs, self.counts = sorted({x for _, x in rows}), {}
        for text, lang in rows:
            for w in self.words(text):
                for key in ((0, w), *((n, g) for n in (5, 4, 3, 2, 1) for g in self.grams(w, n))):
                    of = self.counts.setdefault(key, dict.fromkeys(self.langs, 0))
                    of[lang] += 1
        self.sums = {n: ({x: sum(c[x] for (k, _), c in self.counts.items() if k == n) for x in self.langs}, sum(k == n for k, _ in self.counts)) for n in range(6)}

    @staticmethod
    def words(text):
        return ["".join(g) for letter, g in groupby((text or "").lower(), str.isalpha) if letter]

    @staticmethod
    def grams(w, n):
        w = f"|{w}|" if n > 1 else w
        return [w[k : k + n] for k in range(len(w) - n + 1)]

    def log(self, key, lang):
        sums, size = self.sums[key[0]]
        return math.log((self.counts[key][lang] + 0.5) / (sums[lang] + 0.5 * size + 1))

    def word(self, w):
        if (0, w) in self.counts:
            return {x: self.log((0, w), x) for x in self.langs}
        for n in (5, 4, 3, 2, 1):
            hits = [(n, g) for g in self.grams(w, n) if (n, g) in self.counts]
            if hits:
                return {x: sum(self.log(h, x) for h in hits) / len(hits) for x in self.langs}
        return dict.fromkeys(self.langs, 0.0)

    def predict(self, text):
        words = self.words(text)
        if not words or not self.langs:
            return "und", 0.0
        found = [self.word(w) for w in words]
        total = {x: sum(f[x] for f in found) for x in self.langs}
        best = max(self.langs, key=lambda x: total[x])  # of equals the first
        return best, 1 / sum(math.exp(total[x] - total[best]) for x in self.langs)


def test_predictions_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    plain = PlainLanguages([(t, x) for k, t, x in rows if not out(k) and t is not None and x is not None])
    got = {r["doc_id"]: r for r in language_id.language_digest(docs).collect()}
    assert set(got) == {k for k, _, _ in rows}
    for k, t, _ in rows:
        lang, score = plain.predict(t)
        assert (got[k]["lang_pred"], got[k]["held_out"]) == (lang, out(k)) and got[k]["score"] == pytest.approx(score, abs=1e-6)


def test_odd_texts_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PART", 64)
    rng = random.Random(3)
    stems = {"aa": ["kata", "mola", "suri", "x"], "bb": ["brød", "æble", "kata"], "cc": ["слово", "дело"]}
    rows = [(n, " ".join(rng.choice(stems[x]) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(0, 30))), x) for n, x in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100, None, "aa"), (101, "kata", None), (102, "", "bb"), (3, rows[3][1], "aa")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, plain = language_id.fit_language_model(train), PlainLanguages([(t, x) for _, t, x in rows if t is not None and x is not None])
    texts = [None, "", "12 !", "Kata", "katanga" * 40, "ІЇ qqq 漢字", "слово\nbrød kata", "É", "x", ("suri brødet-" * 30), "a" * 500 + " mola"] + [t for _, t, _ in rows]
    names, shares = model.predict(texts)
    for t, lang, share in zip(texts, names, shares.tolist(), strict=True):
        want = plain.predict(t)
        assert lang == want[0] and share == pytest.approx(want[1], abs=1e-6), t


def test_every_learned_entry_is_kept(spark):
    words = [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz" for d in "abcdefghi"]
    train = spark.createDataFrame([(k, " ".join(words[k::20]), "aa" if k % 2 else "bb") for k in range(20)], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(train)
    assert len(model.keys[0]) == len(words) and len(model.keys[1]) == len(set("".join(words)))


def test_parts_cover_texts_and_end_between_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ,") for _ in range(rng.randint(0, 200))) for _ in range(40)] + [None, "", "a" * 300, " " * 300]
    joined = [""] * len(texts)
    for which, pieces in language_id.parts(texts, 50):
        for k, piece in zip(which, pieces, strict=True):
            assert not (joined[k] and joined[k][-1].isalpha() and piece[0].isalpha())
            joined[k] += piece
    assert joined == [t or "" for t in texts]


def test_stage_rejects_and_relabels(spark):
    import corpus_pipeline

    rows = [(n, f"{'kata mola suri' if n % 2 else 'brød æble ørne'} {n}", "aa" if n % 2 else "bb", "s", 9) for n in range(40)]
    rows += [(100, "kata suri mola", "bb", "s", 9), (101, "brød ørne", None, "s", 9), (102, "12 34", "aa", "s", 9), (103, None, "aa", "s", 9), (104, "", "bb", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("_language", F.lit(1))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got[100] == "aa" and got[101] == "bb" and set(got) == {*range(40), 100, 101}


def test_hundreds_of_languages_and_a_dirty_column(spark):
    """Two hundred languages and a label of its own for each of many rows: the model keeps to its bounds."""
    rng = random.Random(8)
    stem = lambda x: "".join("abcdefghijklmnopqrstuvwxyz"[(x * 7 + k * k) % 26] for k in range(2 + x % 3)) + "abcdefgh"[x % 8] * (1 + x % 5)
    rows = [(x * 10 + k, " ".join(f"{stem(x)}{chr(97 + rng.randrange(26))}{chr(97 + x % 26)}" for _ in range(20)), f"l{x:03d}") for x in range(200) for k in range(10)]
    rows += [(10_000 + k, "noise words here", f"dirty{k}") for k in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(train, languages=200)
    assert model.langs == sorted({x for _, _, x in rows[:2000]})
    names, _ = model.predict([t for _, t, _ in rows[:2000]])
    assert sum(a == x for a, (_, _, x) in zip(names, rows, strict=False)) > 1500
    plain = PlainLanguages([(t, x) for _, t, x in rows[:2000]])
    for text in (rows[5][1], rows[777][1], "unseenword " + rows[3][1]):
        (name,), (share,) = model.predict([text])
        assert (name, pytest.approx(share, abs=1e-6)) == plain.predict(text)
    small = language_id.fit_language_model(train, train_bytes=20_000)
    assert len(small.langs) == 500 and small.more.nbytes < 0.5 * language_id.fit_language_model(train).more.nbytes
