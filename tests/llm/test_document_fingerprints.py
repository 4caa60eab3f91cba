"""Fingerprints against a plain version, sums and differences of them, likeness, and the edited texts of odd tables."""

import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomwork.llm import document_fingerprints as df_


def plain_parts(text):
    return [p for line in text.split("\n") for p in re.split(r"(?<=[.!?]) ", line) if p]


def plain(text):
    signs, wide = [0] * 128, [0, 0]
    for part in plain_parts(text):
        h, weight = hashlib.sha256(part.encode()).hexdigest(), math.isqrt(len(part))
        bits = bin(int(h[:32], 16))[2:].zfill(128)
        signs = [s + (weight if b == "0" else -weight) for s, b in zip(signs, bits, strict=True)]
        wide = [(w + int(h[a : a + 16], 16)) % 2**64 for w, a in zip(wide, (32, 48), strict=True)]
    return signs, "".join(f"{s % 65536:04x}" for s in signs) + "".join(f"{w:016x}" for w in wide)


def plain_likeness(a, b):
    total = sum(x * x for x in a) + sum(x * x for x in b)
    return max(0, 1 - Fraction(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), total)) if total else 1


def sentences(rng, n):
    return [" ".join(f"w{rng.randrange(2000)}" for _ in range(rng.randint(4, 12))) + rng.choice([".", "!", "?"]) for _ in range(n)]


def sample():
    rng = random.Random(6)
    texts = [rng.choice([" ", "\n"]).join(sentences(rng, rng.randint(1, 40))) for _ in range(60)]
    texts += [None, "", "\n\n", "a", "é. Ü! 𐍈? x", "one. one. one.", "no end", " . ", "x" * 70_000, texts[3], texts[3]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [(5 * k - 40, t) for k, t in rows] + [(None, "null id"), (None, None), (20, "the id 20 again"), (20, "the id 20 again")]


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_edited_texts_equal_a_plain_version(spark, partitions):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' place", "'mine' fingerprint", "1 extra").repartition(4)
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        (a, own), (b, changed), (c, _) = plain(t), plain(edited), plain(after)
        want.append((-99 if k is None else k, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, float(plain_likeness(a, b)), float(plain_likeness(a, c))))
    got = sorted((-99 if r[0] is None else r[0], *r[1:]) for r in df_.edited_fingerprints(df, partitions=partitions).collect())
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    for g, w in zip(got, sorted(want), strict=True):
        assert g[5:] == pytest.approx(w[5:])


def test_tables_of_one_document_and_of_none(spark):
    df = spark.createDataFrame([(7, "abcd. ef")], "doc_id long, text string")
    (got,) = df_.edited_fingerprints(df).collect()
    assert got["edited_sha256"] == hashlib.sha256(b"abcdabcd").hexdigest() and got["near_next"] == 1 and got["near_edited"] < 1
    empty = df_.edited_fingerprints(df.limit(0))
    assert empty.count() == 0 and empty.columns == list(got.asDict())


def test_paragraphs_come_and_go(spark):
    rng = random.Random(1)
    kept, more = sentences(rng, 20), sentences(rng, 3)
    mixed = kept + more
    rng.shuffle(mixed)
    rows = [("\n".join(kept), "\n".join(more), " ".join(mixed)), ("", None, ""), ("x", "x", "x\nx")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for c in "abc":
        df = df_.fingerprint(df, c, f"f{c}")
    got = df.select("fa", "fc", df_.added("fa", "fb").alias("sum"), df_.taken("fc", "fb").alias("rest"), df_.likeness("fa", "fc").alias("near"), df_.added("fa", F.lit(None).cast("string")).alias("none")).collect()
    for r in got:
        assert r["sum"] == r["fc"] and r["rest"] == r["fa"] and r["none"] is None
    assert got[0]["near"] > 0.7 and got[1]["near"] == 1 and got[2]["near"] < 1 and got[1]["fa"] == "0" * 544


def test_fingerprints_of_groups_add_up(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), "\n".join(sentences(rng, rng.randint(0, 5))) or None) for _ in range(50)]
    df = df_.fingerprint(spark.createDataFrame(rows, "source string, text string").repartition(5))
    got = {r["source"]: r["fingerprint"] for r in df_.total_fingerprints(df, "source").collect()}
    want = {g or "": plain("\n".join(t for s, t in rows if s == g and t))[1] for g in ("a", "b", None)}
    assert got == want
    assert df_.total_fingerprints(df.limit(0), "source").count() == 0


def test_long_sums_wrap_around():
    text = "\n".join(["x" * 10_000] * 400)  # 400 times the weight 100 leaves 16 bits
    (got,) = df_.Fingerprints.of([text], part=7).digits()
    assert got == plain(text)[1]


def test_edited_documents_are_told_from_others(spark):
    got = df_.edited_fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars >= 500").collect()
    alike = sum(r["near_edited"] > r["near_next"] for r in got)
    assert alike >= 0.97 * len(got) and 0.35 < sorted(r["near_edited"] for r in got)[len(got) // 2] < 0.65


def test_columns_are_replaced_and_rows_stay(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string").withColumn("fingerprint", F.lit("mine"))
    got = df_.fingerprint(df).collect()
    assert len(got) == 3 and all(r["fingerprint"] == plain(r["text"] or "")[1] for r in got) and df_.fingerprint(df.limit(0)).count() == 0
