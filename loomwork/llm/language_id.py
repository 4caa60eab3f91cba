"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. A word that it doesn't know backs off to
the longest character n-grams (5 down to 1, word boundaries included) of which it knows any, scored likewise; a word of
unknown characters says nothing. A document's languages are compared by the sums over its words.

The counts are made by Spark over a bounded sample of labelled rows (documents, bytes and languages have bounds, all of them
parameters) and are added up before the shuffle. Every word and n-gram of the sample is in the model, for each of the
languages that has it and no other, which the sample's bound keeps small enough to broadcast; every document is then
scored where it lies, without a shuffle. Long texts are worked off in parts that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import slices, small_batches, span_hashes

#: Labelled documents that are learned from, of each language and on average: a share of its rows is chosen by hash.
DOCS_PER_LANGUAGE = 2_000
#: Bytes of text that are learned from in all, on average, each language having as many at most; and languages that are learned, those of the most rows.
TRAIN_BYTES, LANGUAGES = 32 << 20, 1_000
#: Characters that are worked off at a time (or one word, if that is longer).
PART = 1 << 18
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


class Words:
    """The words (runs of letters, lower-cased) of some texts as hashes, each distinct word once."""

    def __init__(self, texts: list[str | None]):
        parts = ["", *((t or "").lower() for t in texts), ""]
        codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        inside = _letters()[codes]
        self.codes = np.where(inside, codes, 0)  # what isn't a letter bounds a word
        ends = np.cumsum([len(p) + 1 for p in parts])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        starts, stops = edge[::2], edge[1::2]
        self.text = np.searchsorted(ends[:-1], starts, side="right") - 1
        hashes = span_hashes(self.codes, starts, stops)
        self.hashes, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.stops = starts[first], stops[first]

    def grams(self, words: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of these distinct words, and of which word each is. Longer ones than 1 see boundaries."""
        pad = int(order > 1)
        first, last = self.starts[words] - pad, self.stops[words] + pad
        count = np.maximum(0, last - first - order + 1)
        which = np.repeat(np.arange(len(words)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return span_hashes(self.codes, at, at + order, seed=1), which


def parts(texts: list[str | None], size: int = PART) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of the texts, and of which text each is, about ``size`` characters at a time; parts end between words."""
    which, found, room = [], [], size
    for k, text in enumerate(texts):
        start, text = 0, text or ""
        while start < len(text):
            stop = min(len(text), start + room)
            while stop < len(text) and text[stop].isalpha():
                stop += 1
            which.append(k)
            found.append(text[start:stop])
            room, start = room - (stop - start), stop
            if room <= 0:
                yield which, found
                which, found, room = [], [], size
    if found:
        yield which, found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        langs = part.column("lang").to_numpy()
        texts = part.column("text").to_pylist()
        own = ((x, p) for x in np.unique(langs).tolist() for _, p in parts([texts[k] for k in np.flatnonzero(langs == x).tolist()]))
        for lang, pieces in own:
            words = Words(pieces)
            times = np.bincount(words.which, minlength=len(words.hashes))
            found = [(0, words.hashes, times)]
            for order in ORDERS:
                grams, which = words.grams(np.arange(len(words.hashes)), order)
                keys, at = np.unique(grams, return_inverse=True)
                found.append((order, keys, np.bincount(at, weights=times[which], minlength=len(keys)).astype(np.int64)))
            sizes = [len(k) for _, k, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([k for k, _, _ in found], sizes).astype(np.int32)),
                    pa.array(np.concatenate([k for _, k, _ in found]).view(np.int64)),
                    pa.array(np.full(sum(sizes), lang, dtype=np.int32)),
                    pa.array(np.concatenate([n for _, _, n in found]).astype(np.int64)),
                ],
                names=["kind", "key", "lang", "times"],
            )


@dataclass
class LanguageModel:
    """Log frequencies by language, as far as they differ from those of what a language doesn't have.

    ``keys[kind]`` is sorted, kind 0 for words, else the length of n-grams. ``base`` has for each kind (words, then n-grams
    from the longest) and language the log frequency of what it doesn't have. The keys of all kinds, one kind after the
    other, have the entries from ``ends[k]`` to ``ends[k + 1]``: a language that has the key, and how much more likely it is there.
    """

    langs: list[str]
    keys: dict[int, np.ndarray]
    base: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    more: np.ndarray

    @classmethod
    def of_counts(cls, langs: list[str], kinds: np.ndarray, hashes: np.ndarray, codes: np.ndarray, times: np.ndarray) -> LanguageModel:
        """From the times that each language (by its place in ``langs``) has a word or n-gram: a row for each of these."""
        keys, base, ends, of, more, at = {}, [], [np.zeros(1, dtype=np.int64)], [], [], 0
        for kind in (0, *ORDERS):
            own = np.flatnonzero(kinds == kind)
            own = own[np.lexsort((codes[own], hashes[own]))]
            keys[kind], first = np.unique(hashes[own], return_index=True)
            total = np.bincount(codes[own], weights=times[own], minlength=len(langs))
            base.append(np.log(0.5 / (total + 0.5 * len(keys[kind]) + 1)))
            ends.append(at + np.append(first[1:], len(own))[: len(first)])
            of.append(codes[own])
            more.append(np.log(2.0 * times[own] + 1))  # (n + 0.5) / 0.5
            at += len(own)
        return cls(langs, keys, np.stack(base), np.concatenate(ends), np.concatenate(of), np.concatenate(more))

    def look_up(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[kind]
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
        return known, at

    def parts_of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the distinct words are scored by, in their order: the word, the kind's place, the key's place among all, and its share of the score."""
        known, at = self.look_up(0, words.hashes)
        rest, found = np.flatnonzero(~known), [(np.flatnonzero(known), at[known], np.ones(known.sum()))]
        for order in ORDERS:
            grams, which = words.grams(rest, order)
            known, at = self.look_up(order, grams)
            hits = np.bincount(which[known], minlength=len(rest))
            found.append((rest[which[known]], at[known], 1 / hits[which[known]]))
            rest = rest[hits == 0]
        before = np.cumsum([0, *(len(self.keys[k]) for k in (0, *ORDERS))])
        kind = np.repeat(np.arange(len(found)), [len(w) for w, _, _ in found])
        word, key, share = (np.concatenate(x) for x in zip(*found, strict=True))
        by_word = np.argsort(word, kind="stable")
        return word[by_word], kind[by_word], key[by_word] + before[kind[by_word]], share[by_word]

    def score(self, words: Words) -> np.ndarray:
        """The log frequency of each distinct word by language."""
        at = np.arange(len(words.hashes))
        return self._sums(words, at * max(1, len(at)) + at, np.ones(len(at)), len(at))

    def totals(self, words: Words, of_text: np.ndarray, n_texts: int) -> np.ndarray:
        """The sums over each text's words by language."""
        pairs, times = np.unique(of_text * max(1, len(words.hashes)) + words.which, return_counts=True)
        return self._sums(words, pairs, times, n_texts)

    def _sums(self, words: Words, pairs: np.ndarray, times: np.ndarray, n_texts: int) -> np.ndarray:
        n_langs, n_words = len(self.langs), max(1, len(words.hashes))
        word, kind, key, share = self.parts_of(words)
        size = np.bincount(word, minlength=n_words)
        row, at = _spread(size[pairs % n_words], (np.cumsum(size) - size)[pairs % n_words])
        text, weight, kind, key = (pairs // n_words)[row], times[row] * share[at], kind[at], key[at]
        out = np.bincount(text * len(self.base) + kind, weights=weight, minlength=n_texts * len(self.base)).reshape(n_texts, -1) @ self.base
        row, at = _spread(self.ends[key + 1] - self.ends[key], self.ends[key])
        return out + np.bincount(text[row] * n_langs + self.of[at], weights=weight[row] * self.more[at], minlength=n_texts * n_langs).reshape(n_texts, -1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share; of equal sums the first language in order wins."""
        n_words, total = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), max(1, len(self.langs))))
        for which, pieces in parts(texts):
            words, which = Words(pieces), np.array(which)
            of_text = which[words.text]
            n_words += np.bincount(of_text, minlength=len(texts))
            if self.langs and len(of_text):
                total += self.totals(words, of_text, len(texts))
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = np.round(total, 9).argmax(axis=1)  # sums that are equal but for the order in which they were added
        share = 1 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(axis=1)
        names = [self.langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), n_words.tolist(), strict=True)]
        return names, np.where(n_words > 0, np.minimum(share, 1.0), 0.0)


def _spread(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as its size says, and the places from its start on."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def fit_language_model(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, train_bytes: int = TRAIN_BYTES, languages: int = LANGUAGES) -> LanguageModel:
    """Learn from rows with text and language: from about ``docs_per_language`` rows of each language, chosen by their id's hash.

    If these hold more bytes of text than the language's part of ``train_bytes``, fewer rows are chosen. Of more than
    ``languages`` values those with the most rows are learned (of equals the first in order). So the model, and what
    reaches the driver, has a bound whatever the table holds. The whole texts of the chosen rows count, and everything in
    them is kept. Rows without text or language are left out; repeated rows count as often as they occur.
    """
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 20)).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = {r["lang"]: (r["n"], r["bytes"]) for r in sizes.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    langs = sorted(sizes)
    if not langs:
        none = np.zeros(0, dtype=np.int64)
        return LanguageModel.of_counts([], none, none.view(np.uint64), none, none)
    share = lambda n, size: min(1.0, docs_per_language / n, train_bytes / len(langs) / max(1, size))
    chosen = rows.sparkSession.createDataFrame([(x, k, int(share(*sizes[x]) * (1 << 20))) for k, x in enumerate(langs)], "lang string, code int, below long")
    drawn = small_batches(rows).join(F.broadcast(chosen), "lang").where(F.col("draw") < F.col("below")).select("text", F.col("code").alias("lang"))
    counted = drawn.mapInArrow(_counts, "kind int, key long, lang int, times long")
    top = counted.groupBy("kind", "key", "lang").agg(F.sum("times").alias("times")).toArrow()
    return LanguageModel.of_counts(langs, top["kind"].to_numpy(), top["key"].to_numpy().view(np.uint64), top["lang"].to_numpy(), top["times"].to_numpy())


def identify_languages(df: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """``df`` with a column ``into``: a struct of ``lang`` and ``score`` (the winner's share, 0 to 1).

    Texts that are null or have no letter are ``und`` with score 0, as is every text if nothing was learned. A text in
    which nothing is known gives equal shares and the first language in order. Rows, other columns and repeated rows
    stay as they are (a column named ``into`` is replaced); an empty table gives an empty result.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, shares = [], []
            for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
                lang, share = held.value.predict(part.column("text").to_pylist())
                names += lang
                shares.append(share)
            share = np.concatenate([np.zeros(0), *shares])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(share)], names=["lang", "score"])

    # the annotations are strings here, so the kind of function is given by its type hints at run time
    identify.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # called nondeterministic only lest a filter on the result makes Spark predict twice
    return small_batches(df).withColumn(into, F.arrow_udf(identify, "lang string, score double").asNondeterministic()(F.col(text_col)))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves the remainder ``fold``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def language_digest(docs: DataFrame) -> DataFrame:
    train = docs.where(~held_out())
    found = identify_languages(docs.select("doc_id", "text"), fit_language_model(train))
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
