"""Near copies by a similarity of shingles: SimHash with long fingerprints and multi-index hashing, then the exact similarity.

Each bit of a fingerprint is, as in any SimHash, that of the majority of the shingles' hashes. At a Jaccard similarity of
0.8 about 15 % of the bits differ, far too many for 64 of them within four. Fingerprints are therefore as long as it takes:
``segments`` of some bits each. The table of each segment holds a fingerprint under its value, which probes the Hamming
ball of radius 1 around it (2 if it has few shingles); as in ``simhash`` only the flips from 0 to 1 are enumerated, and
both members of a pair meet in the bitwise "or" of their values. By the pigeonhole principle pairs that differ in fewer
bits than twice the segments all meet; of those that differ in more, so many segments let but one in a thousand pass at
the similarity. A pair that meets is linked if its whole fingerprints, and the bits that fill their last word, are within
``distance`` (``few`` if both have few shingles). A bucket links texts of the same value only if that value is its own: in
the buckets that they probe one text stands for all that are linked, so that each has a link for each segment at most,
not one for each probe, however many are near copies of each other. What is shuffled are rows of zones, values without
their last bits; these are flipped where the zone's rows have come together, as all rows of a bucket are in its zone.

What fingerprints connect is only a candidate. The similarity of a group's texts is computed from whole sets of shingle
hashes: first against the group's sixteen smallest texts, then, where these leave the group in several parts, in cells of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm.components import connected
from loomwork.llm.shared import cut, free_names, held_small, id_order, mix, slices, small_batches, without
from loomwork.llm.simhash import _forest, _masks, bucket_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: The share of pairs of the similarity that may meet in no segment, and texts that share a segment's value (as a power of two) that are aimed at.
MISSED, BUCKET_BITS = 0.001, 11
LEAST_BITS = 12
#: Last bits of a segment's value that are flipped after the shuffle only: what a ball reaches by these goes there as one row.
LATE = 6
#: Bits that differ between texts of a similarity, against what the angle between very long ones gives: at most so many times, by
#: simulation of all sizes up to 200 shingles; those of FEW, the sizes four and five at 0.8, come to 3/16 of the bits.
SHORT, SHORTEST, FEW = 1.07, 1.25, 5
#: Radius of the balls that are probed, for texts of more than FEW shingles and for others.
RADII = (1, 2)
#: Members of a bucket that are compared in one task.
BLOCK = 16_384
#: Texts of a group that all others are compared with first.
HUBS = 16
#: Texts of a group that are compared with its hubs in one task.
GUESTS = 1024
#: Texts and bytes of shingle hashes in a cell's block.
CELL_TEXTS, CELL_BYTES = 256, 4 << 20
#: Links in a partition of what a round of the components hands to the next.
LINKS = 2048


@dataclass(frozen=True)
class Shape:
    """How many segments of how many bits a fingerprint has, and how many of all its bits may differ, also between texts of few shingles."""

    segments: int
    bits: int
    distance: int
    few: int

    @property
    def words(self) -> list[str]:
        """The columns that hold a fingerprint, 64 bits each."""
        return [f"w{k}" for k in range(-(-self.segments * self.bits // 64))]


def shape(count: int, similarity: float = SIMILARITY) -> Shape:
    """For so many texts: bits grow with their logarithm, and segments with what balls in segments of so many bits miss."""
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(LEAST_BITS, count.bit_length() - BUCKET_BITS)
    p = SHORT * differs
    meets = sum(math.comb(bits, r) * p**r * (1 - p) ** (bits - r) for r in range(RADII[0] + 1))
    segments = 1 if meets >= 1 else math.ceil(math.log(MISSED) / math.log(1 - meets))
    size = -(-segments * bits // 64) * 64
    far = [max(2 * segments - 1, math.ceil(size * p + 3.5 * math.sqrt(size * p * (1 - p)))) for p in (SHORT * differs, SHORTEST * differs)]
    return Shape(segments, bits, *far)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64))


def fingerprints(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` words of 64 bits for each set of hashes: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = np.arange(count, dtype=np.uint64)
    counts = np.zeros((len(sets), 64 * len(words)), dtype=np.int64)
    for k, hashes in enumerate(sets):
        for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
            drawn = mix((hashes[at : at + (1 << 14), None] + words).ravel()).astype("<u8")
            counts[k] += np.unpackbits(drawn.view(np.uint8).reshape(-1, 8 * len(words)), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > np.array([len(s) for s in sets], dtype=np.int64)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _sketches(shingle: int, form: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()
        for part in slices(batches, "text", 1 << 18):
            nodes = part.column("node").to_pylist()
            keep = [k for k, n in enumerate(nodes) if n not in last and nodes.index(n) == k]  # copies in a task go
            last = set(nodes) if len(last) > 100_000 else last.union(nodes)
            if not keep:
                continue
            texts = part.column("text")
            sets = [shingle_hashes((texts[k].as_py() or "").encode(), shingle) for k in keep]
            found = fingerprints(sets, len(form.words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(keep)), pa.array([len(s) <= FEW for s in sets]), *(pa.array(np.ascontiguousarray(w)) for w in found.T)], names=["node", "few", *form.words])

    return run


def _zones(form: Shape):
    """Rows ``zone, value, node, few`` and the fingerprint: for each segment its value and the zones that its ball reaches, which are values without their last ``LATE`` bits."""
    early = form.bits - LATE
    balls = [_masks(early, r).astype(np.int64) for r in RADII]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                few, node = part.column("few").to_numpy(zero_copy_only=False), part.column("node").to_numpy()
                words = np.stack([part.column(c).to_numpy() for c in form.words], axis=1)
                value = np.stack([_value(words, np.full(len(words), s), form) for s in range(form.segments)], axis=1)
                high = value >> LATE
                for flips, at in zip(balls, (np.flatnonzero(~few), np.flatnonzero(few)), strict=True):
                    row, segment, flip = np.nonzero((high[at][:, :, None] & flips) == 0)
                    zone = (segment << early) + (high[at][row, segment] | flips[flip])
                    yield pa.RecordBatch.from_arrays([pa.array(zone), pa.array(value[at][row, segment]), pa.array(node[at][row]), pa.array(few[at][row]), *(pa.array(w[at][row]) for w in words.T)], names=["zone", "value", "node", "few", *form.words])

    return run


def _value(words: np.ndarray, segment: np.ndarray, form: Shape) -> np.ndarray:
    """The value of one segment of each row's fingerprint."""
    row, first = np.arange(len(words)), segment * form.bits
    words, shift = words.view(np.uint64), (first % 64).astype(np.uint64)
    value = words[row, first // 64] >> shift
    rest = words[row, np.minimum(first // 64 + 1, words.shape[1] - 1)] << (np.uint64(63) - shift) << np.uint64(1)
    return ((value | rest) & np.uint64((1 << form.bits) - 1)).astype(np.int64)


def _of_zones(zones: DataFrame, form: Shape) -> DataFrame:
    """The rows of ``_posts`` from those of ``_zones``, without a shuffle and without Python, whose workers would stay beside those that verify."""
    spent = F.expr(f"(zone & {(1 << form.bits - LATE) - 1}L) ^ shiftright(value, {LATE})")
    left = F.when(F.col("few"), RADII[1]).otherwise(RADII[0]) - F.bit_count("spent")
    masks = [F.lit(_masks(LATE, r).astype(np.int64).tolist()) for r in range(max(RADII) + 1)]
    balls = F.when(left == 0, masks[0]).when(left == 1, masks[1]).otherwise(masks[2]).cast("array<long>")
    rows = zones.withColumn("spent", spent).withColumn("flip", F.explode(balls)).where("value & flip = 0")
    bucket, kind = F.expr(f"shiftleft(zone, {LATE}) | (value & {(1 << LATE) - 1}L) | flip"), F.expr(f"2 * (shiftleft(spent, {LATE}) | flip) + cast(few as long)")
    return rows.select(bucket.alias("bucket"), "node", *form.words, kind.alias("kind"))


def _posts(form: Shape):
    """Rows ``bucket, node``, the fingerprint and ``kind`` of the table and of the probes; the bucket holds the segment's number and value.

    ``kind`` is twice the flips (0 in the table), and 1 more for few shingles. Probes need not meet probes,
    as one of a pair at a distance of 1 is in the table; those of few shingles, of a radius of 2, must.
    """
    balls = [_masks(form.bits, r).astype(np.int64) for r in RADII]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                few, node = part.column("few").to_numpy(zero_copy_only=False), part.column("node").to_numpy()
                words = np.stack([part.column(c).to_numpy() for c in form.words], axis=1)
                value = np.stack([_value(words, np.full(len(words), s), form) for s in range(form.segments)], axis=1)
                for flips, at in zip(balls, (np.flatnonzero(~few), np.flatnonzero(few)), strict=True):
                    row, segment, flip = np.nonzero((value[at][:, :, None] & flips) == 0)
                    bucket = (segment << form.bits) + (value[at][row, segment] | flips[flip])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node[at][row]), *(pa.array(w[at][row]) for w in words.T), pa.array(2 * flips[flip] + few[at][row])], names=["bucket", "node", *form.words, "kind"])

    return run


def _pairs(few: int):
    """Pairs of rows within the distance, or ``few`` if both have few shingles."""

    def run(words: np.ndarray, distance: int) -> np.ndarray:
        words, kind = words[:, :-1], words[:, -1].astype(np.int64)
        short = np.flatnonzero(kind & 1)
        return np.concatenate([_near(words, (kind & 1 | (kind < 2)) > 0, distance), short[_near(words[short], np.ones(len(short), dtype=bool), few)]])

    return run


def _elsewhere(few: int):
    """Pairs of rows that are within the distance and come with the links of another cell.

    Rows of a bucket that have the same flips have the same value of the segment: all of them are in that value's table,
    whose own bucket links them. Rows of one block that meet another block are linked where the block meets itself.
    """

    def run(first: np.ndarray, side: np.ndarray, words: np.ndarray, distance: int) -> np.ndarray:
        words, kind = words[:, :-1], words[:, -1].astype(np.int64)
        value, out = (kind >> 1) * 3 + side, [np.zeros((0, 2), dtype=np.int64)]
        at = np.flatnonzero((value > 0) & (np.bincount(first, minlength=len(first))[first] > 2))
        at = at[np.lexsort((value[at], first[at]))]
        edge = np.flatnonzero((np.diff(first[at]) != 0) | (np.diff(value[at]) != 0)) + 1
        for rows in (r for r in np.split(at, edge) if len(r) > 1):
            short = rows[kind[rows] & 1 > 0]
            out += [rows[_forest(words[rows], distance)], short[_forest(words[short], few)]]
        return np.concatenate(out)

    return run


def _near(words: np.ndarray, held: np.ndarray, distance: int) -> np.ndarray:
    """Pairs of rows within the distance, one of them held at least: all if there are few, else a spanning forest of them."""
    order, count, least = np.concatenate([np.flatnonzero(held), np.flatnonzero(~held)]), 0, int(held.sum())
    words, linked, out = np.ascontiguousarray(words[order].T), np.zeros(len(order), dtype=bool), [np.zeros((0, 2), dtype=np.int64)]
    for k in range(0, least, 128):
        stop = min(k + 128, least)
        apart = np.zeros((stop - k, len(order) - k), dtype=np.uint16)
        for w in words:
            apart += np.bitwise_count(w[k:stop, None] ^ w[None, k:])
        row, other = np.nonzero(apart <= distance)
        row, other = row[row < other] + k, other[row < other] + k
        linked[row] = linked[other] = True
        count += len(row)
        if count <= 4 * len(order):
            out.append(np.stack([row, other], axis=1))
    if count <= 4 * len(order):
        return order[np.concatenate(out)]
    at = np.flatnonzero(linked)
    return order[at[_forest(words[:, at].T, distance)]]


def fingerprint_links(prints: DataFrame, form: Shape) -> DataFrame:
    """Pairs ``a, b`` of nodes that connect what pairs of ``prints`` (``node, few`` and the fingerprint's words) within the distance connect that meet in a segment."""
    columns = ", ".join(f"{c} long" for c in form.words)
    posts = prints.mapInArrow(_posts(form), f"bucket long, node long, {columns}, kind long")
    zones = prints.mapInArrow(_zones(form), f"zone long, value long, node long, few boolean, {columns}").repartition("zone")
    return bucket_links(posts, [*form.words, "kind"], form.distance, BLOCK, within=_pairs(form.few), elsewhere=_elsewhere(form.few), dealt=_of_zones(zones, form))


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [shingle_hashes((t or "").encode(), shingle).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("component"), part.column("node"), pa.array(found, pa.binary())], names=["component", "node", "hashes"])

    return run


def _near_hubs(similarity: float):
    """For each text the hubs of its component, other than itself, to which it is linked. Rows come by cell, the hubs of a cell first."""

    def near_of(node: int, own: np.ndarray, hubs: list[tuple[int, np.ndarray]]) -> list[int]:
        out = []
        for hub, other in hubs:
            if hub == node or min(len(own), len(other)) < similarity * max(len(own), len(other)) - 1e-6:
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= similarity * (len(own) + len(other) - both) - 1e-6:
                out.append(hub)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, hubs = None, []
        for batch in batches:
            out = []
            for component, salt, guest, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("component", "salt", "guest", "node", "hashes")), strict=True):
                if (component, salt) != cell:
                    cell, hubs = (component, salt), []
                own = np.frombuffer(hashes, dtype=np.uint64)
                if not guest:
                    hubs.append((node, own))
                else:
                    out.append((component, node, len(hashes), any(node == h for h, _ in hubs), near_of(node, own, hubs)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["component", "node", "bytes", "hub", "near"])

    return run


def roots_of_group(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each text of a group the smallest node that links of at least ``similarity`` lead to.

    Each search step compares one text with those not reached yet; sizes too far apart are left out.
    """
    order = np.argsort(nodes, kind="stable")
    sizes, root, rest = np.array([len(s) for s in sets], dtype=np.int64), nodes.copy(), order
    while len(rest):
        first, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            mine, n = sets[at], sizes[at]
            close = np.flatnonzero((sizes[rest] >= similarity * n - 1e-6) & (similarity * sizes[rest] <= n + 1e-6))
            if not len(close):
                continue
            own = sizes[rest[close]]
            flat, owner = np.concatenate([sets[k] for k in rest[close]]), np.repeat(np.arange(len(close)), own)
            place = np.minimum(np.searchsorted(mine, flat), max(n - 1, 0))
            both = np.bincount(owner[mine[place] == flat], minlength=len(close)) if n else np.zeros(len(close), dtype=np.int64)
            near = close[both >= similarity * (n + own - both) - 1e-6]
            root[rest[near]] = nodes[first]
            frontier.extend(rest[near])
            rest = np.delete(rest, near)
    return root


def _roots(similarity: float):
    def settle(nodes: list[int], sets: list[bytes]) -> pa.RecordBatch:
        own = np.array(nodes, dtype=np.int64)
        found = roots_of_group(own, [np.frombuffer(s, dtype=np.uint64) for s in sets], similarity)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(found)], names=["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []
        for batch in batches:
            for *key, node, hashes in zip(*(batch.column(k).to_pylist() for k in ("component", "i", "j", "node", "hashes")), strict=True):
                if key != cell and nodes:
                    yield settle(nodes, sets)
                    nodes, sets = [], []
                cell = key
                if not nodes or nodes[-1] != node:  # a text may be on both sides of a cell
                    nodes.append(node)
                    sets.append(hashes)
        if nodes:
            yield settle(nodes, sets)

    return run


def exact_roots(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of the nodes of ``sets`` (``component, node, hashes``, a row for each node) that links of at least ``similarity`` connect.

    Texts are compared with the component's hubs first: its smallest texts, all of them if it is small. Where these leave
    a component in several parts, the texts of all parts but the largest meet all texts of the component, in cells of a
    block of theirs and a block of all: two texts of different parts may be linked though neither's hub is to the other's.
    """
    sets = cut(sets)
    rank = F.row_number().over(W.partitionBy("component").orderBy("node"))
    first = sets.select("component", "node").withColumn("n", rank).where(F.col("n") <= HUBS).select("component", "node")  # limited before the shuffle
    large = sets.groupBy("component").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("salts")).where("salts > 1")
    large = held_small(cut(large))  # a cell has its component's hubs and so many of its texts
    dealt = sets.join(large, "component", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    guests = dealt.select("component", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("guest"), "node", "hashes")
    hubs = dealt.join(first, ["component", "node"]).select("component", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("guest"), "node", "hashes")
    cells = guests.union(hubs).repartition("component", "salt").sortWithinPartitions("component", "salt", "guest", "node")
    judged = cut(cells.mapInArrow(_near_hubs(similarity), "component long, node long, bytes long, hub boolean, near array<long>"))
    near = F.col("near")
    # links of hubs, and between hubs that have a text in common: a bounded number for each component
    of_hubs = judged.where("hub").select("component", F.col("node").alias("a"), F.explode("near").alias("b"))
    of_hubs = of_hubs.union(judged.where(F.size("near") > 1).select("component", near[0].alias("a"), F.explode(F.slice("near", 2, HUBS)).alias("b"))).distinct()
    roots = of_hubs.groupBy("component").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).select("component", F.explode(_settled("a", "b")).alias("s"))
    lone = judged.where(~F.col("hub") & (F.size("near") > 0)).select("component", near[0].alias("hub")).distinct()  # hubs that only others are linked to
    roots = roots.select("component", "s.hub", "s.root").union(lone.join(of_hubs.select("component", F.col("a").alias("hub")).union(of_hubs.select("component", "b")), ["component", "hub"], "left_anti").select("component", "hub", F.col("hub").alias("root")))
    # a hub may have no link of its own and yet be one of two that a text is linked to
    linked = judged.where(F.col("hub") | (F.size("near") > 0)).select("component", "node", F.when(F.col("hub"), F.col("node")).otherwise(near[0]).alias("hub"))
    linked = cut(linked.join(roots, ["component", "hub"]).select("component", "node", "root"))
    over = cut(_unsettled(judged, linked))
    if over.isEmpty():
        return linked.select("node", "root")
    links = of_hubs.select("a", "b").union(judged.where(~F.col("hub") & (F.size("near") > 0)).select(F.col("node").alias("a"), near[0].alias("b")))
    return connected(links.union(_links_in_cells(sets, judged, over, similarity)), rows=LINKS).select("node", F.col("component").alias("root"))


def _unsettled(judged: DataFrame, linked: DataFrame) -> DataFrame:
    """``component, node, bytes`` of texts that may have a link that no hub shows: those of components in more than one part, but for the part of most texts.

    Hubs have met all texts of their component. Two others that are linked are in one part, or one of them is here.
    """
    own = judged.where("not hub").join(linked, ["component", "node"], "left").select("component", "node", "bytes", F.coalesce("root", "node").alias("root"))
    own = cut(own)
    parts = own.groupBy(F.struct("component", "root").alias("k")).agg(F.count("*").alias("n")).select("k.component", "k.root", "n")
    several = parts.groupBy(F.struct("component").alias("k")).agg(F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("most")).where("parts > 1").select("k.component", "most")
    return own.join(several, "component").where("root <> most").select("component", "node", "bytes")


def _settle(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            root = {n: n for n in (*a, *b)}

            def find(n: int, root: dict[int, int] = root) -> int:
                while root[n] != n:
                    n = root[n]
                return n

            for x, y in zip(a, b, strict=True):
                low, high = sorted((find(x), find(y)))
                root[high] = low
            out.append([{"hub": n, "root": find(n)} for n in root])
        yield pa.array(out, pa.list_(pa.struct([("hub", pa.int64()), ("root", pa.int64())])))


_settle.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def _settled(a: str, b: str):
    """``hub, root`` of a component's hubs: the smallest one that their links ``a, b`` lead to."""
    return F.arrow_udf(_settle, "array<struct<hub: long, root: long>>")(a, b)


def _links_in_cells(sets: DataFrame, judged: DataFrame, over: DataFrame, similarity: float) -> DataFrame:
    """Links of the texts of ``over`` with all of their component, from cells of a block of theirs and a block of all."""
    parts = lambda count, size: F.greatest(F.ceil(count / CELL_TEXTS), F.ceil(size / CELL_BYTES), F.lit(1)).cast("int")
    sizes = judged.groupBy(F.struct("component").alias("k")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).select("k.component", "n", "bytes")
    opened = over.groupBy(F.struct("component").alias("k")).agg(F.count("*").alias("m"), F.sum("bytes").alias("open")).select("k.component", "m", "open")
    sizes = cut(sizes.join(opened, "component").select("component", parts(F.col("n"), F.col("bytes")).alias("nj"), parts(F.col("m"), F.col("open")).alias("ni")))
    held = sets.join(sizes, "component")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = held.select("component", "node", "hashes", place("nj").alias("j"), every("ni").alias("i"))
    mine = held.join(over.select("node"), "node").select("component", "node", "hashes", place("ni").alias("i"), every("nj").alias("j"))
    cells = mine.unionByName(others).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    return cells.select("component", "i", "j", "node", "hashes").mapInArrow(_roots(similarity), "node long, root long").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _named(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """``df`` with a 64-bit name for each text; different texts have different names.

    The name is a hash. Texts that share it, but not their MD5, are named by both instead.
    """
    digest = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))
    slim = df.select(_hash(F.col(text_col)).alias(into), digest.alias("digest"))
    twins = cut(slim.groupBy(into).agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select(into, F.lit(True).alias("_twin")))
    named = df.withColumn(into, _hash(F.col(text_col)))
    if twins.isEmpty():
        return named
    (mark,) = free_names(named, "_twin")
    joined = named.join(held_small(twins.withColumnRenamed("_twin", mark)), into, "left")
    return joined.withColumn(into, F.when(F.col(mark), F.xxhash64(into, digest)).otherwise(F.col(into))).drop(mark)


def near_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with ``kept``: true for one document, that of the smallest id, of each group that links of at least ``similarity`` connect.

    Rows that repeat an id and a text are one document and stay or go together; of several texts of the smallest id one
    stays. Null ids come first, null texts count as empty, texts without words are copies of each other. All columns
    stay; a column ``kept`` of ``df`` is replaced; an empty table gives an empty result. Ids must be whole numbers, or
    text that reads as such. A text is held whole in a task with its hashes, some tens of bytes a word.
    """
    df = without(df, "kept")
    order, key, mark = free_names(df, "_order", "_key", "_gone")
    named = _named(small_batches(df), text_col, key)
    slim = named.select(id_order(id_col).alias("order"), F.col(key).alias("node"), F.col(text_col).alias("text"))
    form = shape(slim.count(), similarity)
    columns = ", ".join(f"{c} long" for c in form.words)
    prints = cut(slim.select("node", "text").mapInArrow(_sketches(shingle, form), f"node long, few boolean, {columns}"))
    groups = connected(fingerprint_links(prints, form), rows=LINKS)
    dealt = slim.join(groups, "node").select("component", "node", "text").mapInArrow(_sets(shingle), "component long, node long, hashes binary")
    roots = exact_roots(dealt.dropDuplicates(["component", "node"]), similarity)
    rows = cut(slim.select("order", "node").join(roots, "node", "left").select("order", "node", F.coalesce("root", "node").alias("root")))
    first = rows.groupBy(F.struct("root").alias("k")).agg(F.min(F.struct("order", "node")).alias("first")).select("k.root", "first")
    gone = rows.join(first, "root").where(F.struct("order", "node") != F.col("first")).select(F.col("order").alias(order), F.col("node").alias(key), F.lit(True).alias(mark)).distinct()
    return named.withColumn(order, id_order(id_col)).join(gone, [order, key], "left").withColumn("kept", F.col(mark).isNull()).drop(order, key, mark)
