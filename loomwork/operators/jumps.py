"""Greedy packing over rows: a document's units needn't lie in one row, nor in one task.

Units get their number and the tokens before them by ranges. They are cut into blocks of so many tokens, each with the
units behind it that its last windows may reach; within a block the start that follows each start is found by binary
search. Where a window that begins near a block's front leaves the block is a jump; jumps are doubled until every block
that a document's windows enter knows where. Each block then walks from its entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.operators import windows
from loomwork.operators.chunking import _UNIT, COLUMNS, ChunkSetting, _chunk_columns

#: A block has the tokens of so many windows.
BLOCK_WINDOWS = 64


def placed(rows: DataFrame, key: str, *order: str, tokens: str = "token_count_est") -> DataFrame:
    """``rows`` with ``pos`` (number within the key from 0), ``before`` (tokens of the rows before) and ``is_last``, from reliable storage.

    Rows are dealt by ranges of key and order; what is summed up over a key is one row for each range that it reaches.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = windows.written(dealt.withColumn("_range", F.shiftright("_at", 33)))
    own = W.partitionBy("_range", key).orderBy("_at")
    local = dealt.withColumns({"pos": F.row_number().over(own) - 1, "before": F.sum(F.col(tokens).cast("long")).over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col(tokens)})
    held = dealt.groupBy("_range", key).agg(F.count("*").alias("_n"), F.sum(F.col(tokens).cast("long")).alias("_t"))
    earlier, all_of = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(key)
    shift = held.select("_range", key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_pos"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(all_of).alias("_all"))
    pos = F.col("pos") + F.col("_pos")
    return local.join(shift, ["_range", key]).select(*rows.columns, pos.alias("pos"), (F.col("before") + F.col("_before")).alias("before"), (pos == F.col("_all") - 1).alias("is_last"))


class _Block:
    """A block's starts (its own units) with, for each, where its window stops and where the next one starts, as places in the block."""

    def __init__(self, table: pa.Table, s: ChunkSetting):
        table = table.sort_by("pos")
        self.pos, self.before, size = (table.column(c).to_numpy() for c in ("pos", "before", "tokens"))
        self.after, home = self.before + size, table.column("home").to_numpy()
        self.block = int(table.column("block")[0].as_py())
        self.own = int((home == self.block).sum())
        at, start = np.arange(self.own), self.before[: self.own]
        full = np.searchsorted(self.after, start + s.target_tokens, side="right")
        self.stop = np.minimum(np.maximum.reduce([full, np.searchsorted(self.before, start + s.min_tokens), at + 1]), len(self.pos))
        self.ends = np.zeros(self.own, dtype=bool)
        if bool(table.column("is_last")[-1].as_py()):
            self.ends = self.stop == len(self.pos)
        self.next = self.stop
        if s.overlap_tokens:
            carried = np.minimum(np.searchsorted(self.before, self.after[self.stop - 1] - s.overlap_tokens), self.stop - 1)
            self.next = np.where(carried > at, carried, np.maximum(at + 1, self.stop - 1))

    def exits(self) -> np.ndarray:
        """For each start the first one behind the block, -1 where the windows end before."""
        jump = np.where(self.ends, -1, self.next)
        while True:
            inside = np.flatnonzero((jump >= 0) & (jump < self.own))
            if not len(inside):
                return np.where(jump < 0, -1, self.pos[0] + jump)
            jump[inside] = jump[jump[inside]]


def _jumps(key: str, schema: pa.Schema, s: ChunkSetting, width: int, reach: int):
    def run(table: pa.Table) -> pa.Table:
        b = _Block(table, s)
        front = np.arange(min(b.own, 1 + int(np.searchsorted(b.before, b.block * width + reach))))
        to = b.exits()[front]
        return pa.Table.from_arrays([pa.array([table.column(key)[0].as_py()] * len(front), schema.field(key).type), pa.array([b.block] * len(front), pa.int64()), pa.array(b.pos[front], pa.int64()), pa.array(to, pa.int64(), mask=to < 0)], names=[key, "block", "at", "to"])

    return run


def _walks(key: str, schema: pa.Schema, s: ChunkSetting):
    def run(table: pa.Table) -> pa.Table:
        entry, found = table.column("entry")[0].as_py(), []
        if entry is not None:
            b = _Block(table, s)
            at = entry - int(b.pos[0])
            while 0 <= at < b.own:
                found.append(at)
                at = -1 if b.ends[at] else int(b.next[at])
        starts = np.array(found, dtype=np.int64)
        columns = [np.zeros(0, dtype=np.int64)] * 4
        if found:
            stops = b.stop[starts]
            columns = [b.pos[starts], b.pos[0] + stops, b.before[starts], b.after[stops - 1]]
        return pa.Table.from_arrays([pa.array([table.column(key)[0].as_py()] * len(found), schema.field(key).type), *(pa.array(c, pa.int64()) for c in columns)], names=[key, "start", "stop", "tokens_before", "tokens_to"])

    return run


def _entries(jumps: DataFrame, key: str, blocks: int) -> DataFrame:
    """``key, block, entry`` for every block but the first that the windows of a key enter; a key has ``blocks`` of them at most."""
    reached, step = jumps.where("at = 0 and block = 0").select(key, "at"), jumps.where("to is not null").select(key, "at", "to")
    covered = 1
    while covered < blocks:
        reached = windows.written(reached.unionByName(reached.join(step, [key, "at"]).select(key, F.col("to").alias("at"))))
        covered *= 2
        if covered < blocks:
            further = step.select(key, F.col("at").alias("to"), F.col("to").alias("then"))
            step = windows.written(step.join(further, [key, "to"]).select(key, "at", F.col("then").alias("to")))
    return reached.join(jumps, [key, "at"]).where("block > 0").select(key, "block", F.col("at").alias("entry"))


def ranges(rows: DataFrame, setting: ChunkSetting, key: str = "source_doc_id", tokens: str = "token_count_est", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``key, chunk_index, start, stop, tokens_before, tokens_to`` of each window over ``rows`` as ``placed`` gives them.

    The windows are those of ``packing_folds``: the next unit is taken while the window is empty, stays within the
    target or is below the least; with overlap the next window begins with units of at most so many tokens of the last.
    A unit may be larger than the target, or than a block. Units have at least one token each: what a task holds is
    bounded by a block's tokens. An empty table has no windows.
    """
    reach = max(setting.target_tokens, setting.min_tokens, 1)
    width = reach * max(1, block_windows)
    home = F.floor(F.col("before") / width)
    near = (home > 0) & (F.col("before") - home * width < reach)
    narrow = rows.select(key, "pos", "before", F.col(tokens).cast("long").alias("tokens"), "is_last", home.alias("home"), F.explode(F.when(near, F.array(home, home - 1)).otherwise(F.array(home))).alias("block"))
    # a block that holds only what lies behind it has no start of its own
    narrow = windows.written(narrow)
    kind, arrow = narrow.schema[key].dataType.simpleString(), narrow.limit(0).toArrow().schema
    blocks = 1 + (narrow.agg(F.max("home")).first()[0] or 0)
    entry = F.when(F.col("block") == 0, F.lit(0).cast("long"))
    if blocks == 1:
        known = narrow.withColumn("entry", entry)
    else:
        many = narrow.join(narrow.where("home > 0").select(key).distinct(), key, "left_semi")
        jumps = windows.written(many.groupBy(key, "block").applyInArrow(_jumps(key, arrow, setting, width, reach), f"{key} {kind}, block long, at long, to long"))
        known = narrow.join(_entries(jumps, key, blocks), [key, "block"], "left").withColumn("entry", F.coalesce("entry", entry))
    found = known.groupBy(key, "block").applyInArrow(_walks(key, arrow, setting), f"{key} {kind}, start long, stop long, tokens_before long, tokens_to long")
    return windows.numbered(found, "chunk_index", "start", key=key)


def flat_chunks(units: DataFrame, setting: ChunkSetting, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``chunking.flat_chunks``, made without a document in one row: units meet their windows by number, windows their neighbours by theirs.

    Units without a document are left out. A window's title is its first unit's.
    """
    key = "source_doc_id"
    rows = windows.written(placed(units.where(F.col(key).isNotNull()).select(key, "source_title", *_UNIT), key, *_UNIT[:4]))
    found = windows.written(ranges(rows, setting, block_windows=block_windows))
    members = found.select(key, "chunk_index", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).join(rows, [key, "pos"])
    own = members.groupBy(key, "chunk_index").agg(F.sort_array(F.collect_list(F.struct("pos", "source_title", *_UNIT))).alias("own"))
    chunks = own.withColumns(_chunk_columns(F.col("own"), setting.name, setting.strategy, setting.target_tokens, setting.overlap_tokens, "flat_chunk") | {"source_title": F.col("own")[0]["source_title"]}).drop("own")
    chunks = chunks.withColumn("chunk_id", F.format_string("%s::%s::%s::%05d", key, F.lit(setting.name), "slug", "chunk_index"))
    chunks = windows.written(chunks.withColumns({"parent_id": F.lit(None).cast("string"), "children_ids": F.array().cast("array<string>")}).join(found.drop("start", "stop"), [key, "chunk_index"]))
    place = F.col("chunk_index")
    before = chunks.select(key, (place + 1).alias("chunk_index"), F.col("chunk_id").alias("prev_chunk_id"), F.col("tokens_to").alias("_to"))
    after = chunks.select(key, (place - 1).alias("chunk_index"), F.col("chunk_id").alias("next_chunk_id"), F.col("tokens_before").alias("_from"))
    linked = chunks.join(before, [key, "chunk_index"], "left").join(after, [key, "chunk_index"], "left")
    shared = lambda a, b: F.coalesce(F.greatest(F.lit(0), a - b), F.lit(0)).cast("int")
    same = {"overlap_with_prev_tokens": F.when(F.col("prev_chunk_id").isNull(), 0).otherwise(shared(F.col("_to"), F.col("tokens_before"))), "overlap_with_next_tokens": F.when(F.col("next_chunk_id").isNull(), 0).otherwise(shared(F.col("tokens_to"), F.col("_from")))}
    return linked.withColumns(same).select(*COLUMNS)
