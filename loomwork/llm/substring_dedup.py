"""Substring deduplication by level-wise doubling.

A window of the full width (20 words) can only repeat if what it contains repeats. At each level (10 words, then twice
that, and so on below the full width) every surviving window is represented by the smallest hash among the shorter
windows it contains: equal windows choose equally, so about one shorter window in six is posted. Posts that occur once
alone end their windows; the windows of the others are extended to twice the length, until the full width is reached
or nothing survives. Only full windows that survived are hashed (96 bits) and compared over all documents, in one
exchange; those that a very frequent post stands for are salted, and their first occurrences are joined back.

Whole texts that occur again (by SHA-256) are settled before: every window of a later copy starts earlier in the first copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.llm.shared import id_order, mix, same_text, slices, small_batches, span_hashes, utf8_bytes, window_hashes, without, word_spans

WINDOW, BASE = 20, 10
#: A window that may occur more often than this, as the window that represents it does, is dealt over so many groups at
#: least, and over half the square root of the count: neither a group's rows nor a window's groups grow faster than that.
HOT, SALTS = 5_000, 32
#: The lower half of a window's second hash gives way to its position: 96 bits remain to tell windows apart.
_POSITION = (1 << 32) - 1
_COPY = -1  # as a position: the whole text has an earlier copy


def levels(window: int = WINDOW, base: int = BASE) -> list[int]:
    """The lengths below ``window``: ``base``, twice that, and so on; of a window no longer than ``base`` its own."""
    out = [min(base, window)]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return out


def _smallest(grams: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` starts the smallest of the ``width`` hashes from there on, and where it first is."""
    best, at = grams[:count].copy(), np.zeros(count, dtype=np.int64)
    for k in range(1, width):
        np.minimum(best, grams[k : k + count], out=best)
    for k in range(width - 1, -1, -1):
        at[grams[k : k + count] == best] = k
    return best, at + np.arange(count)


class _Windows:
    """The full windows of a slice of documents that survive the levels done so far."""

    def __init__(self, batch: pa.RecordBatch, window: int, done: list[int]):
        data, offsets = utf8_bytes(batch.column("text"))
        starts, ends, self.first_word = word_spans(data, offsets)
        self.words, self.window, self._spans = span_hashes(data, starts, ends), window, (data, starts, ends)
        self.count = max(0, len(self.words) - window + 1)
        self.alive = same_text(self.first_word, self.count, window) if self.count else np.zeros(0, dtype=bool)
        self.post = None
        for length in done:
            self.post = self.represent(length)[0]
            self.alive &= np.isin(self.post, self.listed(batch, f"hits{length}"))

    @staticmethod
    def listed(batch: pa.RecordBatch, column: str) -> np.ndarray:
        return batch.column(column).flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the full windows at these places, of words that were hashed apart as well."""
        return span_hashes(self.words, at, at + self.window), span_hashes(span_hashes(*self._spans, seed=1), at, at + self.window, seed=1)

    def represent(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        return _smallest(window_hashes(self.words, length), self.count, self.window - length + 1)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_word, at, side="right") - 1


def _post(window: int, length: int, done: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = _Windows(part, window, done)
            if not w.alive.any():
                continue
            value, at = w.represent(length)
            value, at = value[w.alive], at[w.alive]
            new = np.concatenate([[True], at[1:] != at[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), part.column("doc_order").take(pa.array(w.text_of(at[new])))], names=["post", "doc_order"])

    return run


def _full(window: int, done: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = _Windows(part, window, done)
            at = np.flatnonzero(w.alive)
            if not len(at):
                continue
            text = w.text_of(at)
            h1, h2 = (h.view(np.int64) for h in w.digests(at))
            take = pa.array(text)
            docs = mix(part.column("doc_order").to_numpy().view(np.uint64))[text]
            salt = np.zeros(len(at), dtype=np.int64)
            hot, first = np.unique(w.listed(part, "hot"), return_index=True)
            if len(hot):
                groups = part.column("groups").flatten().to_numpy(zero_copy_only=False)[first].astype(np.uint64)
                place = np.minimum(np.searchsorted(hot, w.post[at]), len(hot) - 1)
                salt = np.where(hot[place] == w.post[at], 1 + (docs % groups[place]).astype(np.int64), 0)
            tail = (h2 & ~_POSITION) | (at - w.first_word[text])  # a row is a few bytes shorter than with two columns
            columns = [pa.array(h1), pa.array(tail), pa.array(salt.astype(np.int32)), part.column("doc_order").take(take), part.column("text_key").take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "tail", "salt", "doc_order", "text_key"])

    return run


def later_windows(base: DataFrame, window: int = WINDOW, shortest: int = BASE) -> DataFrame:
    """``doc_order, text_key, position`` of every window whose words also start earlier; copies at position -1.

    ``base`` has ``doc_id, doc_order, text_key, text``. It is dealt by ``doc_order`` alone, always with these columns, so that
    one exchange serves every level and the caller.
    """
    texts = base.select("doc_order", "text_key", F.unhex(F.sha2("text", 256)).alias("digest"))
    # the first of each text, aggregated before the shuffle; which rows these are is told by their own order, a key that is never hot
    firsts = texts.groupBy("digest").agg(F.min("doc_order").alias("first"), F.min("text_key").alias("first_key")).select("first", "first_key")
    is_first = (F.col("doc_order") == F.col("first")) & (F.col("text_key").bitwiseXOR(F.col("first_key")) == 0)
    copies = base.select("doc_order", "text_key").join(firsts, is_first, "left_anti")
    posts_of, done, alive, lengths = base.select("doc_order", "text"), [], None, levels(window, shortest)
    for length in lengths:
        posts = posts_of.mapInArrow(_post(window, length, done), "post long, doc_order long")
        # counted under another key than the join's, so that the join gets exchanges which Spark splits where a post is hot
        repeated = posts.groupBy(F.struct("post").alias("k")).agg(F.count("*").alias("times")).where("times > 1").select("k.post", "times")
        found = [F.collect_set("post").alias(f"hits{length}")]
        if length == lengths[-1]:
            found.append(F.collect_set(F.when(F.col("times") > HOT, F.struct("post", F.greatest(F.lit(SALTS), F.ceil(F.sqrt("times") / 2)).cast("int").alias("groups")))).alias("many"))
        hits = posts.join(repeated, "post").groupBy("doc_order").agg(*found)
        if length == lengths[-1]:
            hits = hits.select("doc_order", f"hits{length}", F.col("many.post").alias("hot"), F.col("many.groups").alias("groups"))
        alive = hits if alive is None else alive.join(hits, "doc_order")
        done.append(length)
        posts_of = base.join(alive, "doc_order")
    # a text that is a later copy brings no window of its own
    survivors = (base if alive is None else base.join(alive, "doc_order")).join(firsts, is_first, "left_semi")
    full = survivors.mapInArrow(_full(window, done), "h1 long, tail long, salt int, doc_order long, text_key long")
    # one exchange serves the first of each window and salt, their minima over the salts, and the comparison with both
    position = F.col("tail").bitwiseAND(F.lit(_POSITION))
    dealt = full.repartition("h1", "salt").withColumns({"h2": F.shiftright("tail", 32), "position": position, "at": F.struct("doc_order", position.alias("position"))})
    local = dealt.withColumn("first", F.min("at").over(W.partitionBy("h1", "salt", "h2")))
    salted = dealt.where("salt > 0").groupBy("h1", "h2", "salt").agg(F.min("at").alias("at"))
    # handed back to the salts that the window has; one that lies under a single salt needs nothing
    overall = salted.groupBy("h1", "h2").agg(F.min("at").alias("overall"), F.collect_list("salt").alias("salts")).where(F.size("salts") > 1)
    overall = overall.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.explode("salts").alias("os"), "overall")
    # the second hash is compared outside the join's keys, which are then those of the exchange
    same = (F.col("h1") == F.col("o1")) & (F.col("salt") == F.col("os")) & (F.col("h2").bitwiseXOR(F.col("o2")) == 0)
    later = local.join(overall, same, "left").where(F.col("at") > F.coalesce("overall", "first"))
    return later.select("doc_order", "text_key", "position").union(copies.select("doc_order", "text_key", F.lit(_COPY).cast("long")))


def _strip(window: int, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            later = part.column("later")
            positions, ends = later.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(later), 0).to_numpy())
            n_words, n_removed, kept = [], [], []
            for k in range(part.num_rows):
                words = (part.column("text")[k].as_py() or "").encode().split()
                mine = positions[ends[k - 1] if k else 0 : ends[k]]
                n_words.append(len(words))
                if len(mine) and len(words) >= window:
                    if mine.min() == _COPY:
                        words = []
                    else:
                        depth = np.bincount(mine, minlength=len(words) + 1) - np.bincount(mine + window, minlength=len(words) + 1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[: len(words)]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*schema, "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, shortest: int = BASE) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text`` (the words that stay, joined by one space).

    Words are runs of characters other than 20 and 09-0D. Each word is removed that a window of ``window`` consecutive
    words covers whose sequence also starts earlier: in a smaller id, or earlier in the same document. Windows are judged
    on the input. Null texts have no words. Null ids sort first. Rows that repeat an id and text are one document;
    neither is an earlier one of the other. Columns of ``df`` named like the new ones are replaced, others pass through;
    an empty table gives an empty result. Ids must be whole numbers, or text that reads as such. A text is worked off in
    one task, in memory of some hundred bytes a word.
    """
    df = without(small_batches(df), "n_words", "n_removed", "kept_text")
    carried = [c for c in df.columns if c != text_col]
    # the key tells texts of one id apart; where ids don't repeat, a constant costs nothing to shuffle
    repeats = df.groupBy(id_order(id_col).alias("doc_order")).count().where("count > 1").limit(1).count()
    key = F.xxhash64(text_col) if repeats else F.lit(0).cast("long")
    base = df.select(F.struct(*carried).alias("row"), id_order(id_col).alias("doc_order"), key.alias("text_key"), F.col(text_col).alias("text"))
    later = later_windows(base, window, shortest).groupBy(F.col("doc_order").alias("later_order"), F.col("text_key").alias("later_key")).agg(F.collect_list(F.col("position").cast("int")).alias("later"))
    # the keys of the join are those by which the texts were dealt already
    joined = base.join(later, (F.col("doc_order") == F.col("later_order")) & (F.col("text_key").bitwiseXOR(F.col("later_key")) == 0), "left").drop("later_order", "later_key")
    row = base.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_strip(window, ["row", "text"]), f"row {row}, text string, n_words long, n_removed long, kept_text string")
    return out.select(*(F.col("row")[c].alias(c) for c in carried), F.col("text").alias(text_col), "n_words", "n_removed", "kept_text")


def substring_dedup_digest(docs: DataFrame) -> DataFrame:
    found = substring_dedup(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
