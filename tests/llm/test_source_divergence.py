"""The audit of sources against plain Python, radix selection against sorting, and edge cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, k):
    """``rows`` of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, TERM.findall(text.translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs = Counter(w for x, _, ws in words if x == lang for w in set(ws))
        kept = {w for w, n in docs.items() if n >= least}
        sources = sorted({r[2] for r in rows if r[1] == lang})
        counts = {s: Counter(w for x, y, ws in words if (x, y) == (lang, s) for w in ws if w in kept) for s in sources}
        counts[None] = sum(counts.values(), Counter())
        share = {s: {t: 1 + 1_000_000_000 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(share[s][t] - share[None][t], t) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", more)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, n + 1) for n, (v, item) in enumerate(order) if part == "pair" or n < k}
    return out


def sample(n=400):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("na", "Tö", "über", "x", "tion") for b in ("re", "re", "ly", "é", "zz", "")]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "д", "e f"])) for _ in range(n)]
    rows += [(None, "en", "null text"), ("", "en", ""), ("9 8 _", "it", "alone"), ("rare words here", "fr", "s1"), ("others there", "fr", "s2"), (" ".join(words * 3000), "en", "long")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'mine' term", "'mine' value", "'mine' rank", "1 g", "2 n").repartition(6)


@pytest.mark.parametrize(("sources", "terms"), [(128, 256), (2, 3)])
def test_audit_equals_plain_python(spark, monkeypatch, sources, terms):
    monkeypatch.setattr(sd, "CELL_SOURCES", sources)
    monkeypatch.setattr(sd, "CELL_TERMS", terms)
    rows = sample()
    got = [tuple(r) for r in sd.source_divergence(frame(spark, rows), k=5).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 30, 5)


def test_repeated_rows_and_empty_tables(spark):
    rows = [("one two", "en", "a"), ("one three", "en", "b")] * 20
    assert {tuple(r) for r in sd.source_divergence(frame(spark, rows)).collect()} == plain(rows, 30, 50)
    nothing_kept = [("one two", "en", "a"), ("one three", "en", "b")]
    got = {tuple(r) for r in sd.source_divergence(frame(spark, nothing_kept)).collect()}
    assert got == plain(nothing_kept, 30, 50) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    empty = sd.source_divergence(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_radix_selection_equals_sorting(spark):
    """Few values and many terms of one value, with long common beginnings, bytes beyond ASCII and terms that begin others."""
    rng = random.Random(2)
    rows = []
    for g, values in (("ties", [7]), ("few", [0, 1, 2**30 - 1]), ("many", range(2**30)), ("small", [5, 6])):
        items = {"x" * rng.choice([0, 1, 200, 201]) + rng.choice(["", "é", "z", "ab", "\U00010348"]) + str(rng.randrange(50)) for _ in range(300)} if g != "small" else {"b", "a", "ab"}
        rows += [(g, i, rng.choice(values)) for i in items]
    df = spark.createDataFrame(rows, "g string, item string, value long").select(F.struct("g").alias("g"), F.col("item").cast("binary").alias("item"), "value")
    got = {(r["g"]["g"], bytes(r["item"]).decode(), r["value"], r["rank"]) for r in sd.radix_top(df, 20).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))
        want |= {(*r, n + 1) for n, r in enumerate(order[:20])}
    assert got == want


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 10**15 + 7, 3 * 10**15 + 1, 10**9
    (got,) = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(sd.share(F.col("n"), F.col("total"), F.col("terms"), 5)).first()
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)
