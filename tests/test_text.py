"""Text measures against plain Python on hand-made and random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T

PROBES = ["", " ", "Don't Stop", "Don'T Stop", "3Rd Part", "3rd part", "A-B", "THE Nature", "THE NATURE OF PARTS", "Ünï Cödé", "one two three.", "Is it? Or not? Well.", "- a", "- a\n- b", "1. first", "• x", "x" * 130, "a b c d e f g h i j k", "AB CD: EF", "Straße und Größe", "École Française"]
PROBES += ["".join(random.Random(n).choice("ab cD.E?!\n9_é ") for _ in range(60)) for n in range(80)]


def rows(spark, *columns):
    df = spark.createDataFrame([(n, p) for n, p in enumerate(PROBES)], "n int, t string")
    return [tuple(r)[1:] for r in df.select("n", *columns).orderBy("n").collect()]


def test_words_tokens_and_sentences(spark):
    t = F.col("t")
    for p, (w, k, s) in zip(PROBES, rows(spark, T.word_count(t), T.estimate_tokens(t), T.sentences(t)), strict=True):
        words = len(re.findall(r"\b\w+\b", p))
        flat = re.sub(r"\s+", " ", p).strip()
        assert (w, k) == (words, max(1, round(words * 1.3))), p
        assert s == [x for x in re.split(r"(?<=[.!?])\s+", flat) if x.strip()], p


def test_title_and_ratio(spark):
    t = F.col("t")
    for p, (title, ratio, made) in zip(PROBES, rows(spark, T.is_title(t), T.uppercase_ratio(t), T.title_case(t)), strict=True):
        letters = [c for c in p if c.isalpha()]
        assert title == (p == p.title()), p
        assert ratio == pytest.approx(sum(c.isupper() for c in letters) / len(letters) if letters else 0), p
        if "ß" not in p:
            assert made == p.title(), p


def test_headers_and_types(spark):
    t = F.col("t")
    found = dict(zip(PROBES, rows(spark, T.is_likely_header(t), T.paragraph_type(t, F.lit(None).cast("string"))), strict=True))
    assert found["THE NATURE OF PARTS"][0] and found["Don'T Stop"][0] and not found["one two three."][0] and not found[""][0]
    assert [found[p][1] for p in ("", "- a", "- a\n- b", "1. first", "Is it? Or not? Well.", "• x")] == ["empty", "list_item", "body", "numbered_item", "exercise_or_prompt", "list_item"]


@pytest.mark.parametrize(("words", "tokens"), [(5, 6), (15, 20), (0, 1)])
def test_half_even(spark, words, tokens):
    assert spark.range(1).select(T.tokens_of_words(F.lit(words))).first()[0] == tokens


def test_slug_and_preview(spark):
    got = spark.range(1).select(T.slug(F.lit("Ch 1: A--B!")), T.slug(F.lit(None)), T.slug(F.lit("!!")), T.preview(F.lit(" a\n b " + "c" * 20), 6), T.preview(F.lit(None).cast("string"), 5)).first()
    assert tuple(got) == ("ch_1_a_b", "unknown", "unknown", "a b cc...", "")


def test_noise_header_and_pages(spark):
    got = spark.range(1).select(T.is_noise_header(F.lit("T HE N P")), T.is_noise_header(F.lit("The End")), T.is_page_marker(F.lit(" === Page 12 === ")), T.is_page_marker(F.lit("page 12"))).first()
    assert tuple(got) == (True, False, True, False)
