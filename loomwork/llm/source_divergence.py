"""Audit of how sources of a language diverge in their words.

Terms are counted once: each task counts the terms of its own texts for every source before anything is shuffled. The
terms that enough documents of a language have are kept, and every source of the language gives each of them a smoothed
share, in whole numbers.

**Pairs of sources.** A term that a source lacks has the same share as all others that it lacks, the source's baseline.
The distance of two sources is that of their baselines for every kept term, corrected where one of them has a term. The
corrections are summed up in cells of bounded size (some terms, a block of sources against another), each from what the
sources have, and then over the cells.

**Terms of a source.** Of the terms that a source has more of than its language, the k-th largest difference is found by
radix selection: histograms over the values' bits, from the highest on, tell for each source in which bucket the k-th
lies; the histogram of the next bits looks into that bucket alone. Where more terms have that very difference than are
wanted, histograms over the bytes of the terms go on in the same way. What is ordered in the end are k rows of each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm.shared import cut, held_small, slices, small_batches, stored, utf8_bytes, word_spans

SCALE, SMOOTHING = 1_000_000_000, 5
#: Bits of a value that one histogram tells apart, and of the largest value.
DIGIT_BITS, VALUE_BITS = 10, 30
#: Terms and sources on either side of a cell.
CELL_TERMS, CELL_SOURCES = 256, 128
#: Each byte of a term in lower case (A-Z alone), and 0 for those that no term has.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:65] = _LOWER[91:97] = _LOWER[123:128] = 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of the texts, for every language, source and term: how often it occurs, and in how many documents."""
    for part in slices(batches, "text", 4 << 20):
        data, offsets = utf8_bytes(part.column("text"))
        low = _LOWER[data]
        starts, ends, first = word_spans(data, offsets, low == 0)
        if not len(starts):
            continue
        edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(low[low > 0])]).dictionary_encode()
        term, n_terms = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        keys = [part.column(c).dictionary_encode() for c in ("lang", "source")]
        lang, source = (k.indices.to_numpy().astype(np.int64) for k in keys)
        group = lang * len(keys[1].dictionary) + source
        in_document, times = np.unique(np.repeat(np.arange(part.num_rows), np.diff(first)) * n_terms + term, return_counts=True)
        found, which = np.unique(group[in_document // n_terms] * n_terms + in_document % n_terms, return_inverse=True)
        at = found // n_terms
        yield pa.RecordBatch.from_arrays(
            [
                keys[0].dictionary.take(pa.array(at // len(keys[1].dictionary))),
                keys[1].dictionary.take(pa.array(at % len(keys[1].dictionary))),
                words.dictionary.take(pa.array(found % n_terms)).cast(pa.binary()),
                pa.array(np.bincount(which, weights=times, minlength=len(found)).astype(np.int64)),
                pa.array(np.bincount(which, minlength=len(found)).astype(np.int64)),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of a table of ``lang, source, text``: occurrences of each term, and rows that have it."""
    counted = small_batches(docs).select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, smoothing: int) -> Column:
    """1 + floor(SCALE * (n + smoothing) / (total + smoothing * terms)), exactly; null if there are no terms."""
    whole = lambda c: c.cast("decimal(19,0)")
    above, below = (whole(n) + smoothing) * F.lit(SCALE).cast("decimal(10,0)"), whole(total) + whole(terms) * smoothing
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def _at_rank(rows: DataFrame, digit: Column, order, *kept: Column) -> DataFrame:
    """For each group ``g`` the bucket of a histogram over ``digit`` in which its row number ``want`` lies: ``digit, n``, how many of them are wanted, and ``kept``."""
    hist = rows.groupBy(F.struct("g", digit.alias("digit")).alias("k")).agg(F.count("*").alias("n"), F.max("want").alias("wanted"), *kept)
    upto = F.sum("n").over(W.partitionBy("k.g").orderBy(order("k.digit")).rowsBetween(W.unboundedPreceding, 0))
    found = hist.withColumn("before", upto - F.col("n")).where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("n") >= F.col("wanted")))
    return found.select("k.g", "k.digit", "n", (F.col("wanted") - F.col("before")).alias("want"), *(c for c in found.columns if c not in ("k", "n", "wanted", "before")))


def _common(a: str, b: str) -> Column:
    """The longest binary that both begin with."""
    same = lambda k, i: F.when((k == i - 1) & F.col(a).substr(i, F.lit(1)).eqNullSafe(F.col(b).substr(i, F.lit(1))), i).otherwise(k)
    size = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), same)
    return F.col(a).substr(F.lit(1), size)


def radix_top(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of each group ``g`` with the largest ``value`` (from 0 to below 2**VALUE_BITS), ties to the smaller ``item``; ``rank`` counts from 1.

    ``rows`` has ``g, item, value`` and is read several times; items (binary) are different within a group. A group of
    at most ``k`` rows gives all of them.
    """
    bounds = None
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        if bounds is None:
            seen = rows.withColumns({"want": F.lit(k).cast("long"), "high": F.lit(0).cast("long")})
        else:
            seen = rows.join(held_small(bounds.select("g", "want", "high")), "g").where(F.shiftright("value", shift + DIGIT_BITS) == F.col("high"))
        found = _at_rank(seen, F.shiftright("value", shift).bitwiseAND((1 << DIGIT_BITS) - 1), F.desc, F.max("high").alias("high"))
        bounds = cut(found.select("g", "n", "want", (F.shiftleft("high", DIGIT_BITS) + F.col("digit")).alias("high")))
    # the rows that have the very value at the rank: all are wanted, or some, by the order of their items' bytes
    settled = bounds.where("n = want").select("g", "high", F.lit(None).cast("binary").alias("upto"))
    open_ = cut(bounds.where("n > want").select("g", "high", "want", F.lit(b"").alias("prefix")))
    while not open_.isEmpty():
        size = F.length("prefix")
        seen = rows.join(held_small(open_), "g").where((F.col("value") == F.col("high")) & (F.col("item").substr(F.lit(1), size) == F.col("prefix")))
        found = _at_rank(seen, F.col("item").substr(size + 1, F.lit(1)), F.asc, F.max("high").alias("high"), F.min("item").alias("low"), F.max("item").alias("top"))
        found = cut(found.select("g", "high", "n", "want", "top", _common("low", "top").alias("prefix")))
        settled = settled.union(found.where("n = want").select("g", "high", "top"))
        open_ = found.where("n > want").select("g", "high", "want", "prefix")
    held = rows.join(held_small(cut(settled)), "g", "left")
    tied = (F.col("value") == F.col("high")) & (F.col("upto").isNull() | (F.col("item") <= F.col("upto")))
    best = held.where(F.col("high").isNull() | (F.col("value") > F.col("high")) | tied)
    return best.select("g", "item", "value", F.row_number().over(W.partitionBy("g").orderBy(F.desc("value"), "item")).alias("rank"))


def _corrections(key, table):
    """Of one cell: for pairs of sources, what terms that either has add to the distance of their baselines."""
    lang, _, i, j = (k.as_py() for k in key)
    rows = table.to_pandas()
    marks = rows[rows["term"].isna()].drop_duplicates("source").sort_values("source", ignore_index=True)
    names, block, base = marks["source"].to_numpy(), marks["block"].to_numpy(), marks["p"].to_numpy(dtype=np.int64)
    rows = rows[rows["term"].notna()]
    who, (what, terms) = pd.Index(names).get_indexer(rows["source"]), pd.factorize(rows["term"])
    p = rows["p"].to_numpy(dtype=np.int64)
    shares = np.repeat(base[:, None], len(terms), axis=1)
    shares[who, what] = p
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for n, a in enumerate(left):  # terms that the left one has
        at = what[who == a]
        other = shares[right][:, at]
        total[n] += (np.abs(shares[a, at] - other) - np.abs(base[a] - other)).sum(axis=1)
    for n, b in enumerate(right):  # and those of the right one, against baselines
        own = p[who == b]
        total[:, n] += np.abs(base[left][:, None] - own).sum(axis=1) - len(own) * np.abs(base[left] - base[b])
    a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    once = a < b if i == j else np.ones(len(a), dtype=bool)
    a, b, total = a[once], b[once], total.ravel()[once]
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(total)], names=["lang", "a", "b", "value"])


def pair_distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language, both ways.

    ``rows`` has ``lang, source, term, p`` of the terms that a source has, ``groups`` ``lang, source, terms, base`` of all.
    """
    counts = groups.groupBy("lang").agg(F.ceil(F.count("*") / CELL_SOURCES).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.max("terms") / CELL_TERMS)).cast("int").alias("buckets"))
    counts = held_small(cut(counts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    block = place("source", "blocks").alias("block")
    has = rows.join(counts, "lang").select("lang", "source", "term", "p", place("term", "buckets").alias("bucket"), block, every("blocks").alias("other"))
    marks = groups.where("terms > 0").join(counts, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), block, "blocks", every("buckets").alias("bucket"))
    marks = marks.select("lang", "source", "term", "p", "bucket", "block", every("blocks").alias("other"))
    cells = has.unionByName(marks).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    parts = cells.groupBy("lang", "bucket", "i", "j").applyInArrow(_corrections, "lang string, a string, b string, value long")
    sums = cut(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("more")))
    both = sums.union(sums.select("lang", "b", "a", "more")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "more")
    # the result has a row for every two sources: this join makes it
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("of_item"))
    pairs = groups.join(held_small(other), "lang").where(F.col("source") != F.col("item"))
    apart = F.coalesce(F.col("terms") * F.abs(F.col("base") - F.col("of_item")), F.lit(0)) + F.coalesce("more", F.lit(0))
    return pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", apart.cast("long").alias("value"))


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, k: int = 50, smoothing: int = SMOOTHING) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from every other of its language, and the terms that it has more of than the language.

    A term is a run of letters A-Z (in lower case) and characters beyond ASCII; a language keeps those in at least
    ``least_docs`` of its rows. Null texts, languages and sources count as empty ones. Part ``pair`` has all other
    sources of the language by distance (0 if no term is kept), part ``term`` the ``k`` terms with the largest
    difference to the language's share; equal values go by the item's UTF-8 bytes. Sources without terms have pairs
    alone, a language's only source none. Repeated rows are documents of their own; an empty table gives an empty
    result; other columns are ignored. A text is held whole in a task.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))
    counts = stored(term_counts(docs))
    terms = counts.groupBy(F.struct("lang", "term").alias("k")).agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    terms = stored(terms.select("k.lang", "k.term", "all"))
    rows = stored(counts.join(held_small(terms), ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    langs = cut(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("whole")))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(held_small(langs), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("whole", F.lit(0)).alias("whole"))
    groups = cut(groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("terms"), smoothing)))
    priced = rows.join(held_small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"), smoothing))
    more = F.col("p") - share(F.col("all"), F.col("whole"), F.col("terms"), smoothing)
    above = stored(priced.select(F.struct("lang", "source").alias("g"), F.col("term").cast("binary").alias("item"), more.alias("value")).where("value > 0"))
    pairs = pair_distances(priced.select("lang", "source", "term", "p"), groups.select("lang", "source", "terms", "base"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = radix_top(above, k).select("g.lang", "g.source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(best)
