"""Document fingerprints that can be added and taken away: homomorphic multiset hashes of paragraphs.

A fingerprint is the sum of wide vectors, one for each paragraph, every component modulo a power of two. The order of
paragraphs doesn't matter, a paragraph put in or taken out is one vector added or subtracted, and the fingerprints of
documents add up to that of all their paragraphs. The vectors come from the paragraph's SHA-256:

* 128 components modulo 2**16 are plus or minus the paragraph's weight, by the bits of the first half. The sum of their
  squares estimates the weights' squares of whatever two fingerprints don't share, so that the difference of two
  fingerprints tells how alike the documents are, without either text.
* two components modulo 2**64 are the second half. With the signs they tell different documents apart.

A paragraph is what stands between line breaks; the sentences of a long line (a mark and a blank end one) count as
paragraphs of their own, so that a change within a line leaves the rest. Its weight is the whole part of the root of its
length, so that squares are lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import id_order, slices, small_batches

SIGNS, WIDE = 128, 2
_DIGITS = 4 * SIGNS + 16 * WIDE


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, in order, repeats included; empty ones don't count."""
    lines = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
    return [x for x in lines if x]


class Fingerprints:
    """Fingerprints of some texts: ``signs`` modulo 2**16 and ``wide`` modulo 2**64, a row for each."""

    def __init__(self, signs: np.ndarray, wide: np.ndarray):
        self.signs, self.wide = signs, wide

    @classmethod
    def of(cls, texts: list[str], part: int = 1 << 14) -> Fingerprints:
        found = [paragraphs(t) for t in texts]
        signs, wide = np.zeros((len(texts), SIGNS), dtype=np.int64), np.zeros((len(texts), WIDE), dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        flat = [x for own in found for x in own]
        for k in range(0, len(flat), part):
            some, who = flat[k : k + part], owner[k : k + part]
            digests = np.frombuffer(b"".join(hashlib.sha256(x.encode()).digest() for x in some), dtype=np.uint8).reshape(-1, 32)
            weight = np.sqrt(np.array([len(x) for x in some], dtype=np.float64)).astype(np.int32)
            signed = (1 - 2 * np.unpackbits(digests[:, : SIGNS // 8], axis=1).astype(np.int32)) * weight[:, None]
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            signs[who[first]] += np.add.reduceat(signed, first, axis=0)
            wide[who[first]] += np.add.reduceat(np.ascontiguousarray(digests[:, SIGNS // 8 :]).view(">u8").astype(np.uint64), first, axis=0)
        return cls(signs & 0xFFFF, wide)

    @classmethod
    def read(cls, digits: list[str]) -> Fingerprints:
        raw = np.frombuffer(bytes.fromhex("".join(digits)), dtype=np.uint8).reshape(-1, _DIGITS // 2)
        signs = np.ascontiguousarray(raw[:, : 2 * SIGNS]).view(">u2").astype(np.int64)
        return cls(signs, np.ascontiguousarray(raw[:, 2 * SIGNS :]).view(">u8").astype(np.uint64))

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints((self.signs + other.signs) & 0xFFFF, self.wide + other.wide)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints((self.signs - other.signs) & 0xFFFF, self.wide - other.wide)

    def __getitem__(self, rows) -> Fingerprints:
        return Fingerprints(self.signs[rows], self.wide[rows])

    def digits(self) -> list[str]:
        """Hexadecimal digits: four for each sum of signs, sixteen for each wide one."""
        raw = np.concatenate([self.signs.astype(">u2").view(np.uint8), self.wide.astype(">u8").view(np.uint8)], axis=1)
        text = raw.tobytes().hex()
        return [text[k : k + _DIGITS] for k in range(0, len(text), _DIGITS)]

    def squares(self) -> np.ndarray:
        """The sum of squares of the sums of signs, which lie between -2**15 and 2**15."""
        return ((((self.signs + (1 << 15)) & 0xFFFF) - (1 << 15)) ** 2).sum(axis=1)

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """The share of both documents' lengths that lies in paragraphs of both, as the signs estimate it: 1 for equal ones, about 0 for others."""
        total = self.squares() + other.squares()
        return np.where(total > 0, np.maximum(0.0, 1 - (self - other).squares() / np.maximum(total, 1)), 1.0)


def _fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out: list[str] = []
        for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
            out += Fingerprints.of([t or "" for t in part.column("text").to_pylist()]).digits()
        yield pa.array(out, pa.string())


def _pairwise(act, kind):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            both = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
            rows = pa.array(both)
            found = act(Fingerprints.read(a.take(rows).to_pylist()), Fingerprints.read(b.take(rows).to_pylist())) if len(both) else []
            out = [None] * len(a)
            for k, x in zip(both.tolist(), found, strict=True):
                out[k] = x
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return run


_fingerprint.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def fingerprint(df: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text, in hexadecimal digits; null counts as empty, whose fingerprint is zero.

    A column named ``into`` is replaced, all others and all rows stay; an empty table gives an empty result. A text is
    held whole in a task, its paragraphs are hashed in parts.
    """
    return small_batches(df).withColumn(into, F.arrow_udf(_fingerprint, "string")(F.col(text_col)))


def added(a: Column | str, b: Column | str) -> Column:
    """The fingerprint of all paragraphs of both; null if either is."""
    return F.arrow_udf(_pairwise(lambda x, y: (x + y).digits(), pa.string()), "string")(a, b)


def taken(a: Column | str, b: Column | str) -> Column:
    """The fingerprint of the first without the paragraphs of the second; null if either is."""
    return F.arrow_udf(_pairwise(lambda x, y: (x - y).digits(), pa.string()), "string")(a, b)


def likeness(a: Column | str, b: Column | str) -> Column:
    """How alike the documents of two fingerprints are (0 to 1); null if either is."""
    return F.arrow_udf(_pairwise(lambda x, y: x.likeness(y).tolist(), pa.float64()), "double")(a, b)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's rows of each group add up to."""
    held: dict = {}
    for batch in batches:
        groups = batch.column("group").dictionary_encode()
        found = Fingerprints.read([x or "0" * _DIGITS for x in batch.column("fingerprint").to_pylist()])
        which = groups.indices.to_numpy(zero_copy_only=False)
        for k, g in enumerate(groups.dictionary.to_pylist()):
            own = found[which == k]
            one = Fingerprints(own.signs.sum(axis=0, keepdims=True) & 0xFFFF, own.wide.sum(axis=0, dtype=np.uint64, keepdims=True))
            held[g] = held[g] + one if g in held else one
        if len(held) > 10_000:
            yield _totals_batch(held)
            held = {}
    if held:
        yield _totals_batch(held)


def _totals_batch(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.digits()[0] for x in held.values()], pa.string())], names=["group", "fingerprint"])


def total_fingerprints(df: DataFrame, group: str, fingerprint_col: str = "fingerprint") -> DataFrame:
    """``group, fingerprint``: the fingerprint of all paragraphs of each group's documents, from their fingerprints alone.

    Tasks add up their own rows first; null fingerprints count as empty, null groups as the empty text.
    """
    slim = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"), F.col(fingerprint_col).alias("fingerprint"))
    parts = slim.mapInArrow(_totals, "group string, fingerprint string")
    return parts.repartition("group").mapInArrow(_totals, "group string, fingerprint string").select(F.col("group").alias(group), F.col("fingerprint").alias(fingerprint_col))


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the bounds (in order) are at most ``value``, by halving."""
    held = F.lit(bounds).cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1))) if bounds else F.array(F.lit(1))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & (F.get(held, n + s - 1) <= value), n + s).otherwise(n))


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each one's edited text has the beginning of the next one's for its own last half."""
    last: list = []
    for batch in batches:
        for part in slices([batch], "text"):
            rows = last + [(*r, t or "") for *r, t in zip(*(part.column(c).to_pylist() for c in ("place", "extra", "doc_id", "text")), strict=True)]
            own = Fingerprints.of([r[3] for r in rows])
            at = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
            last = rows[-1:]
            if not at:
                continue
            texts = [rows[k][3][: (len(rows[k][3]) + 1) // 2] + rows[k + 1][3][: len(rows[k][3]) // 2] for k in at]
            edited, mine, after = Fingerprints.of(texts), own[at], own[[k + 1 for k in at]]
            columns = [
                pa.array([rows[k][2] for k in at], part.column("doc_id").type),
                pa.array([len(rows[k][3]) for k in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                pa.array(mine.digits(), pa.string()),
                pa.array(edited.digits(), pa.string()),
                pa.array(mine.likeness(edited)),
                pa.array(mine.likeness(after)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A text is edited by putting the first code points of the next document's text (all, if they are fewer) in the place
    of its last half, rounded down. Next is the document of the next smaller id; the first follows the last. Null ids come
    last, rows of one id in the order of their texts, null texts count as empty, and a document alone follows itself.
    An empty table gives an empty result; other columns are ignored. Ids must be whole numbers, or text that reads as such.

    Rows are dealt once, by ranges of ids. Each range also gets the rows of the id that comes after its last one, so that
    a task sees every next document without another exchange.
    """
    spark = df.sparkSession
    slim = small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), id_order(id_col).alias("order"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = slim.agg(F.percentile_approx("order", [k / count for k in range(1, count)] or [0.5], max(10_000, 20 * count)).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    place = _below(cuts, F.col("order"))
    heads = {r["place"]: r["head"] for r in slim.select("order").groupBy(place.alias("place")).agg(F.max("order").alias("head")).collect()}  # a row for each range
    ranges = sorted(heads)
    before = dict(zip(ranges, ranges[1:] + ranges[:1], strict=True))  # the range whose last row the first one of this range follows
    head = F.get(F.lit([heads.get(k) for k in range(len(cuts) + 1)]).cast("array<long>"), F.col("place"))
    goes = F.get(F.lit([before.get(k, 0) for k in range(len(cuts) + 1)]).cast("array<int>"), F.col("place"))
    at = F.array(F.struct(F.col("place"), F.lit(False).alias("extra")))
    more = F.array(F.struct(goes.alias("place"), F.lit(True).alias("extra")))
    dealt = slim.withColumn("place", place).withColumn("to", F.explode(F.when(F.col("order") == head, F.concat(at, more)).otherwise(at)))
    dealt = dealt.select("to.place", "to.extra", "doc_id", "text", "order").repartitionById(len(cuts) + 1, "place")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.sortWithinPartitions("place", "extra", F.desc("order"), "text").mapInArrow(_edit, schema)
