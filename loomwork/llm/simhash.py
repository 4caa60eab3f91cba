"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. With three of them (21, 21 and 22 bits), two fingerprints that differ in at most four
bits differ in at most one bit of one of the first two, or agree in the third (else they would differ in two, two and one
bits at least). The table holds each fingerprint under its segment values; each fingerprint probes the Hamming balls of
its segments' radii. Of a ball only the flips from 0 to 1 are enumerated: the other flips are the partner's, and both meet
in the bitwise "or" of their values. Whole distances are then verified within each bucket of the table. Longer segments
and larger balls are taken for more fingerprints, so that buckets stay small.

Buckets are counted first. A pair of a bucket differs in at most four of the bits outside the segment, too, and so agrees in
one of five pieces of these: members of a bucket that is larger than a block are posted again, under their pieces. What is
larger than a block even then is cut into blocks, each pair of which is compared in a task of its own. What the links of a bucket connect is handed on as one link a member, to the smallest one; over all
buckets a member keeps the link to the smallest of these, and the others are linked with that one in its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import connected, contracted
from loomwork.llm.shared import NULL_ID, cut, free_names, id_order, mix, slices, small_batches, without

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: (first bit, bits, radius) of each segment for a distance of at most 4: for few fingerprints, and for more than MANY.
SEGMENTS, LONG_SEGMENTS, MANY = ((0, 21, 1), (21, 21, 1), (42, 22, 0)), ((0, 32, 2), (32, 32, 1)), 1 << 25
#: Members of a block; buckets up to TINY are compared pair by pair all at once, up to SMALL as a matrix, else by searching from member to member.
BLOCK, SMALL, TINY = 2048, 256, 16
#: Buckets of more than a block are listed in a broadcast table up to this number.
BROADCAST_BUCKETS = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """How many of a text's shingle hashes set each of the 64 bits, and (last) how many shingles there are."""
    words = text.lower().split()
    if not words:
        return np.zeros(65, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    out = np.zeros(65, dtype=np.int64)
    for k in range(0, len(starts), 1 << 16):  # bounded memory for very long texts
        spans = zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        out[:64] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[64] += len(hashes)
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts = np.stack([fingerprint((t or "").encode(), shingle) for t in part.column("text").to_pylist()])
            bits = np.packbits(counts[:, :64] * 2 > counts[:, 64:], axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(bits.view("<i8")[:, 0])], names=["doc_id", "text_key", "fp"])

    return run


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` and ``fp``, the fingerprint as a long; null texts count as empty, which gives zero."""
    slim = small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_fingerprints(shingle), "doc_id long, text_key long, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    """The flips of at most ``radius`` of so many bits."""
    return np.array([sum(1 << b for b in found) for n in range(radius + 1) for found in combinations(range(bits), n)], dtype=np.uint64)


def _posts(segments):
    """Rows ``bucket, node, segment`` of the table and of the probes; the bucket mixes the segment's number and value."""
    masks = [_masks(bits, radius) for _, bits, radius in segments]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                fp = batch.column("node").slice(k, 1024).to_numpy().view(np.uint64)
                found, owner, segment = [], [], []
                for number, ((first, bits, _), flips) in enumerate(zip(segments, masks, strict=True)):
                    value = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                    row, flip = np.nonzero((value[:, None] & flips) == 0)
                    found.append(mix((value[row] | flips[flip]) + np.uint64(number << 48)))
                    owner.append(row)
                    segment.append(np.full(len(row), number, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(fp[np.concatenate(owner)].view(np.int64)), pa.array(np.concatenate(segment))], names=["bucket", "node", "segment"])

    return run


def _pieces(segments, distance: int = DISTANCE):
    """Members of a bucket under the pieces of their bits outside its segment: ``bucket, node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fp = batch.column("bucket").to_numpy().view(np.uint64), batch.column("node").to_numpy().view(np.uint64)
            out, number = [], batch.column("segment").to_numpy()
            for n, (first, bits, _) in enumerate(segments):
                at = np.flatnonzero(number == n)
                low = fp[at] & np.uint64((1 << first) - 1)
                rest = low | (fp[at] >> np.uint64(first + bits) << np.uint64(first)) if first + bits < 64 else low
                width = -(-(64 - bits) // (distance + 1))
                for p in range(distance + 1):
                    piece = rest >> np.uint64(p * width) & np.uint64((1 << width) - 1)
                    out.append((at, mix(bucket[at] ^ mix(piece + np.uint64((p + 1) << 48)))))
            at, found = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(fp[at].view(np.int64))], names=["bucket", "node"])

    return run


def _forest(words: np.ndarray, distance: int) -> np.ndarray:
    """Pairs of rows of ``words`` that span what links connect; each search step compares one row with those not reached yet."""
    rest, out = np.arange(len(words)), []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(words[rest] ^ words[at]).sum(axis=1, dtype=np.int32) <= distance
            frontier.extend(rest[near])
            out.append(np.stack([np.full(near.sum(), at), rest[near]], axis=1))
            rest = rest[~near]
    return np.concatenate([np.zeros((0, 2), dtype=np.int64), *out])


def _links_of_bucket(words: np.ndarray, distance: int) -> np.ndarray:
    """Pairs of rows within the distance: all if there are few, else a spanning forest of them."""
    if len(words) <= SMALL:
        pairs = np.argwhere(np.triu(np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2, dtype=np.int32) <= distance, 1))
        if len(pairs) <= 4 * len(words):
            return pairs
    return _forest(words, distance)


def _smallest(pairs: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` rows the first one that pairs lead to."""
    first, a, b = np.arange(count), pairs[:, 0], pairs[:, 1]
    while True:
        least = np.minimum(first[a], first[b])
        new = first.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def _verify(columns: list[str], distance: int, within=None, elsewhere=None):
    def values(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().astype(np.int64) if c in batch.schema.names else np.zeros(batch.num_rows, dtype=np.int64) for c in names], axis=1)

    def links(cell: np.ndarray, side: np.ndarray, node: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))
        size = np.diff(np.append(edge, len(cell)))
        tiny = 1 if within else TINY
        found = [edge[k] + (within or _links_of_bucket)(words[edge[k] : edge[k] + size[k]], distance) for k in np.flatnonzero(size > tiny)]
        which = np.repeat(np.where(size <= tiny, np.arange(len(size)), -1), size)
        for lag in range(1, int(size[size <= tiny].max(initial=1))):  # neighbours at each lag, over all tiny buckets
            at = np.flatnonzero((which[lag:] == which[:-lag]) & (which[lag:] >= 0))
            at = at[np.bitwise_count(words[at] ^ words[at + lag]).sum(axis=1, dtype=np.int32) <= distance]
            found.append(np.stack([at, at + lag], axis=1))
        first = _smallest(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), len(node))
        linked = node[first] != node
        if elsewhere:  # one row stands for those that another cell links
            stands = _smallest(elsewhere(first, side, words, distance), len(node))
            linked &= (stands == np.arange(len(node))) & (stands[first] != stands)
        linked = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[first[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, side, node, words = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, len(columns)), dtype=np.uint64)
        for batch in batches:
            new = values(batch, ["bucket", "i", "j"]), values(batch, ["side"])[:, 0], batch.column("node").to_numpy(), values(batch, columns).view(np.uint64)
            cell, side, node, words = (np.concatenate(c) for c in zip((cell, side, node, words), new, strict=True))
            done = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))  # the last cell may go on
            if len(done):
                stop = done[-1] + 1
                yield links(cell[:stop], side[:stop], node[:stop], words[:stop])
                cell, side, node, words = cell[stop:], side[stop:], node[stop:], words[stop:]
        if len(cell):
            yield links(cell, side, node, words)

    return run


def bucket_links(posts: DataFrame, columns: list[str], distance: int, block: int | None = None, pieces=None, within=None, elsewhere=None, dealt: DataFrame | None = None) -> DataFrame:
    """Pairs ``a, b`` of nodes that connect what the links in the buckets connect; ``columns`` (64 bits each) of a link differ in at most ``distance`` bits.

    ``posts`` has ``bucket``, ``node`` and the columns. Buckets of more than ``block`` rows are posted anew by ``pieces``, if
    that is given (it takes and gives rows of ``posts``); else they are cut into blocks by the nodes' hashes, and every
    pair of blocks is a cell of its own. ``within``, if given, finds a bucket's pairs of rows by the columns and the distance in its own way.
    ``elsewhere``, if given, tells which pairs of a cell's rows come with the links of other cells, by the first row that each
    is linked to, its ``side`` (1 or 2 where two blocks meet, else 0), the columns and the distance; these are not linked again. ``dealt``, if given, has the rows of ``posts`` with each bucket in one
    partition; only the rows of large buckets are shuffled then.
    """
    return contracted(_links(posts, columns, distance, block or BLOCK, pieces, within, elsewhere, dealt))


def _links(posts: DataFrame, columns: list[str], distance: int, block: int, pieces, within, elsewhere, dealt=None) -> DataFrame:
    own = list(dict.fromkeys(["node", *columns]))
    large = posts.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = cut(large.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    count = large.count()
    held = F.broadcast(large) if count <= BROADCAST_BUCKETS else large
    if dealt is not None and count <= BROADCAST_BUCKETS:
        rest = dealt.join(held, "bucket", "left_anti") if count else dealt
        rest = _verified(rest.sortWithinPartitions("bucket", "node"), columns, distance, within, elsewhere)
        return rest.union(_links(posts.join(held, "bucket", "left_semi"), columns, distance, block, pieces, within, elsewhere)) if count else rest
    if count and pieces:
        again = posts.join(held, "bucket", "left_semi").mapInArrow(pieces, f"bucket long, {', '.join(f'{c} long' for c in own)}")
        rest = posts.join(held, "bucket", "left_anti")
        return _cells(rest.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), *own), columns, distance, within, elsewhere).union(_links(again, columns, distance, block, None, within, elsewhere))
    if count:
        spread = posts.join(held, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        spread = spread.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("bucket", *own, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        side = F.when(F.col("mine") < F.col("other"), 1).when(F.col("mine") > F.col("other"), 2).otherwise(0).alias("side")
        return _cells(spread.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *[side][: 1 if elsewhere else 0], *own), columns, distance, within, elsewhere)
    return _cells(posts.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), *own), columns, distance, within, elsewhere)


def _cells(cells: DataFrame, columns: list[str], distance: int, within, elsewhere) -> DataFrame:
    return _verified(cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node"), columns, distance, within, elsewhere)


def _verified(dealt: DataFrame, columns: list[str], distance: int, within, elsewhere) -> DataFrame:
    return dealt.mapInArrow(_verify(columns, distance, within, elsewhere), "a long, b long").where("a != b")


def fingerprint_links(distinct: DataFrame, count: int, block: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of different fingerprints (``fp``) that connect what links of at most four bits' distance connect."""
    segments = LONG_SEGMENTS if count > MANY else SEGMENTS
    posts = distinct.select(F.col("fp").alias("node")).mapInArrow(_posts(segments), "bucket long, node long, segment int")
    return bucket_links(posts, ["node"], DISTANCE, block, _pieces(segments))


def _components(prints: DataFrame) -> DataFrame:
    """``prints`` with ``root``, which names the component, and ``component_order``, the smallest id in the order of ``id_order``."""
    distinct = cut(prints.groupBy("fp").agg(F.min(id_order("doc_id")).alias("rep")))
    groups = connected(fingerprint_links(distinct, distinct.count()))
    # a component's id is the smallest document id of its fingerprints; fingerprints without links stand alone
    rooted = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    # grouped under another key than the join's, which Spark can split then where a component is large
    smallest = rooted.groupBy(F.struct("root").alias("k")).agg(F.min("rep").alias("component_order")).select("k.root", "component_order")
    return prints.join(rooted.join(smallest, "root").select("fp", "root", "component_order"), "fp")


def simhash_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable by links, the row's own included; null ids come first, so that a
    component with a null id has a null ``component_id``. Equal texts have equal fingerprints and meet in one
    component without being paired. Texts without words have fingerprint zero, linked like any other. Repeated rows
    stay; an empty table gives an empty result; other columns are ignored. Ids must be whole numbers, or text that reads
    as such. A text is held whole in a task, its shingles are hashed in parts.
    """
    return _components(cut(fingerprints(df, text_col, id_col))).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_order") != F.lit(NULL_ID), F.col("component_order")).alias("component_id"),
    )


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``kept``: true for one document of each component, that of the smallest id; all columns stay.

    Rows that repeat an id and a text are one document and stay or go together; of several texts of the smallest id one
    stays. Null ids come first. Only ids and hashes are compared; the texts are shuffled once, to be told. A column
    ``kept`` of ``df`` is replaced, all others stay; an empty table gives an empty result. Texts may be of any length.
    """
    df = without(df, "kept")
    order, key, mark = free_names(df, "_order", "_key", "_stays")
    found = _components(cut(fingerprints(df, text_col, id_col)))
    stays = found.where(id_order("doc_id") == F.col("component_order")).groupBy("root", "component_order").agg(F.min("text_key").alias("text_key"))
    stays = stays.select(F.col("component_order").alias(order), F.col("text_key").alias(key), F.lit(True).alias(mark))
    keyed = df.withColumns({order: id_order(id_col), key: F.xxhash64(text_col)})
    return keyed.join(stays, [order, key], "left").withColumn("kept", F.coalesce(mark, F.lit(False))).drop(order, key, mark)
