"""Greedy packing of ordered items as folds over arrays.

A fold's state holds only where chunks start and stop, so that its arrays stay small; texts are sliced afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import let

RANGE = "array<struct<start:int,stop:int>>"


def pack_by_words(parts: Column, words: Column, too_many) -> Column:
    """Strings of neighbouring ``parts`` joined by a space; a part that would make ``too_many(words)`` true begins the next.

    ``words`` has the count of each part.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("words"), F.lit(0).alias("at"))

    def step(s: Column, w: Column) -> Column:
        fresh = (s["at"] == 0) | too_many(s["words"] + w)
        starts = F.when(fresh, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"])
        return F.struct(starts.alias("starts"), F.when(fresh, w).otherwise(s["words"] + w).alias("words"), (s["at"] + 1).alias("at"))

    starts = F.aggregate(words, zero, step, lambda s: s["starts"])
    return slices_from(parts, starts, lambda own: F.array_join(own, " "))


def slices_from(parts: Column, starts: Column, body) -> Column:
    """``body`` of each slice of ``parts`` that begins at one of ``starts`` and ends before the next."""

    def cut(x: Column) -> Column:
        stop = lambda i: F.coalesce(F.get(x["starts"], i + 1), F.size(x["parts"]))
        return F.transform(x["starts"], lambda s, i: body(F.slice(x["parts"], s + 1, stop(i) - s)))

    return let(F.struct(starts.alias("starts"), parts.alias("parts")), cut)


def merge_small(parts: Column, is_small) -> Column:
    """Each small part (but the first) joins the one before it, with a space between. A part alone decides, so that no fold is needed."""

    def merged(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda p, i: F.when((i == 0) | ~is_small(p), i)), lambda i: i.isNotNull())
        return slices_from(x, starts, lambda own: F.array_join(own, " "))

    return let(parts, merged)


def pack_without_overlap(tokens: Column, target: int, least: int) -> Column:
    """Ranges of items: the next one is taken while the chunk is empty, stays within ``target``, or is below ``least``."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("tokens"), F.lit(0).alias("at"))

    def step(s: Column, t: Column) -> Column:
        takes = (s["at"] > 0) & ((s["tokens"] + t <= target) | (s["tokens"] < least))
        starts = F.when(takes, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"])))
        return F.struct(starts.alias("starts"), F.when(takes, s["tokens"] + t).otherwise(t).alias("tokens"), (s["at"] + 1).alias("at"))

    starts = F.aggregate(F.transform(tokens, lambda t: t.cast("int")), zero, step, lambda s: F.concat(s["starts"], F.array(s["at"])))
    ends = lambda v: F.transform(F.slice(v, 1, F.size(v) - 1), lambda x, i: F.struct(x.alias("start"), F.get(v, i + 1).alias("stop")))
    return let(starts, ends)


def overlapping_ranges(tokens: list[int], target: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Ranges in which each chunk begins with the items of the last that together have ``overlap`` tokens at most.

    One item is carried in any case; if all of a chunk would be, its last item is (nothing of a chunk of one item).
    """
    ranges, start, stop = [], 0, 0
    while stop < len(tokens):
        total, stop = 0, start
        while stop < len(tokens) and (stop == start or total + tokens[stop] <= target or total < least):
            total += tokens[stop]
            stop += 1
        ranges.append((start, stop))
        back, first = tokens[stop - 1], stop - 1
        while first > start and back + tokens[first - 1] <= overlap:
            first -= 1
            back += tokens[first]
        start = first if first > start else max(start + 1, stop - 1)
    return ranges


def pack_with_overlap(tokens: Column, target: int, overlap: int, least: int) -> Column:
    """The ranges of ``overlapping_ranges``: how many items are carried depends on all before, so Python counts them, from token counts alone."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [None if x is None else [{"start": a, "stop": b} for a, b in overlapping_ranges(x, target, overlap, least)] for x in batch.to_pylist()]
            yield pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RANGE)(tokens)
