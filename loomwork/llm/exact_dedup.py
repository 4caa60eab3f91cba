"""Exact deduplication by Grace hashing.

Records are dealt by the hash of their content. Inside a task they are gathered up to a bound; beyond it they are
partitioned recursively, by further bits of the hash, into spill files of the task (gone when it ends; a task that is
run again reads its shuffle input again), until each bucket fits an open-addressing table that compares whole contents.

The table runs twice: first over each input partition, without a shuffle, so that a text with very many copies
leaves one record per partition; then over the buckets of all partitions' records.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import free_names, small_batches, without

#: Bytes of content that a task holds in memory at a time.
BUCKET_BYTES = 16 << 20
FAN_OUT_BITS = 4
_SCHEMA = pa.schema([("hash", pa.int64()), ("content", pa.large_binary()), ("rows", pa.int64()), ("best_length", pa.int64()), ("best_id", pa.int64()), ("has_id", pa.bool_())])


def distinct_slots(hashes: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """For each record the first record with the same content, by linear probing in an open-addressing table.

    All records probe at once: free slots go to the first that asks, occupants are compared by hash, then by content;
    who finds another content moves on by one slot.
    """
    count = len(hashes)
    size = 1 << max(4, int(2 * count - 1).bit_length())
    table = np.full(size, count, dtype=np.int64)
    owner = np.arange(count)
    slot = (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    waiting = np.arange(count)
    while len(waiting):
        at = slot[waiting]
        free = table[at] == count
        np.minimum.at(table, at[free], waiting[free])
        found = table[at]
        same = (found == waiting) | (hashes[found] == hashes[waiting])
        for k in np.flatnonzero(same & (found != waiting)):
            same[k] = contents[found[k]] == contents[waiting[k]]
        owner[waiting[same]] = found[same]
        waiting = waiting[~same]
        slot[waiting] = (slot[waiting] + 1) & (size - 1)
    return owner


def collapse(batch: pa.Table) -> pa.Table:
    """One record per distinct content: the rows it stands for, and the longest original, then smallest id, of them."""
    batch = batch.combine_chunks()
    contents = batch["content"].to_pylist()
    owner = distinct_slots(batch["hash"].to_numpy(), contents)
    rows, length = batch["rows"].to_numpy(), batch["best_length"].to_numpy()
    has, ids = batch["has_id"].to_numpy(zero_copy_only=False), batch["best_id"].fill_null(0).to_numpy()
    order = np.lexsort((ids, ~has, -length, owner))
    first = np.concatenate([[True], owner[order][1:] != owner[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
    keep = order[first]
    total = np.bincount(owner, weights=rows, minlength=len(owner)).astype(np.int64)
    return pa.table([batch["hash"].take(pa.array(keep)), pa.array([contents[k] for k in keep], pa.large_binary()), pa.array(total[owner[keep]]), pa.array(length[keep]), pa.array(ids[keep]), pa.array(has[keep])], schema=_SCHEMA)


class _Spill:
    """Spill files of one recursion step: each takes the records whose next bits of the hash are its number."""

    def __init__(self, folder: str, depth: int):
        self.shift, self.paths = np.uint64(FAN_OUT_BITS * depth), [os.path.join(folder, str(k)) for k in range(1 << FAN_OUT_BITS)]
        self.files = [pa.OSFile(p, "wb") for p in self.paths]
        self.writers = [pa.ipc.new_stream(f, _SCHEMA) for f in self.files]

    def deal(self, batch: pa.Table) -> None:
        bucket = batch["hash"].to_numpy().view(np.uint64) >> self.shift & np.uint64((1 << FAN_OUT_BITS) - 1)
        for k in np.unique(bucket):
            self.writers[k].write_table(batch.filter(pa.array(bucket == k)))

    def buckets(self):
        for writer, file in zip(self.writers, self.files, strict=True):
            writer.close()
            file.close()
        for path in self.paths:
            with pa.OSFile(path, "rb") as file, pa.ipc.open_stream(file) as reader:
                yield (pa.Table.from_batches([x]) for x in reader)
            os.remove(path)


def grace(batches: Iterator[pa.Table], bucket_bytes: int = BUCKET_BYTES, depth: int = 0) -> Iterator[pa.Table]:
    """Distinct contents of ``batches``; each depth of the recursion uses other bits of the hash."""
    held, size, spill = [], 0, None
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > bucket_bytes and depth < 64 // FAN_OUT_BITS:
                held = [collapse(pa.concat_tables(held))]  # copies go before anything is written
                size = held[0].nbytes
                if size > bucket_bytes // 2:
                    spill = spill or _Spill(folder, depth)
                    spill.deal(held[0])
                    held, size = [], 0
        last = collapse(pa.concat_tables(held)) if held else None
        if spill is None:
            if last is not None:
                yield last
            return
        if last is not None:
            spill.deal(last)
        for bucket in spill.buckets():
            yield from grace(bucket, bucket_bytes, depth + 1)


def _run(bucket_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # parts of a batch, so that what is held grows by small steps
        parts = (pa.Table.from_batches([b.slice(k, 512)]).cast(_SCHEMA) for b in batches for k in range(0, b.num_rows, 512))
        for found in grace(parts, bucket_bytes):
            yield from found.to_batches(max_chunksize=512)

    return run


def normalized(text):
    """The text without the characters 20 and 09-0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def exact_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per distinct normalised content: ``text_sha256``, ``group_size``, ``keep_id``, ``keep_length``.

    The row to keep is the one with the most code points in the original, then the smallest id (null ids last).
    """
    text, content = F.coalesce(F.col(text_col), F.lit("")), normalized(F.col(text_col))
    records = small_batches(df).select(
        F.xxhash64(content).alias("hash"),
        content.cast("binary").alias("content"),
        F.lit(1).cast("long").alias("rows"),
        F.length(text).cast("long").alias("best_length"),
        F.col(id_col).cast("long").alias("best_id"),
        F.col(id_col).isNotNull().alias("has_id"),
    )
    schema = "hash long, content binary, rows long, best_length long, best_id long, has_id boolean"
    local = records.mapInArrow(_run(bucket_bytes), schema)
    dealt = local.repartition(_buckets(df), "hash")
    return dealt.mapInArrow(_run(bucket_bytes), schema).select(
        F.sha2("content", 256).alias("text_sha256"),
        F.col("rows").alias("group_size"),
        F.when(F.col("has_id"), F.col("best_id")).alias("keep_id"),
        F.col("best_length").alias("keep_length"),
    )


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` for every row; all its columns stay.

    Texts are equal when identical after deleting every character 20 and 09-0D; null counts as empty. Of equal texts
    the row with the most code points in the original stays, then the smallest id; null ids come last. Rows that
    repeat an id with a text of the same length in the group are the same document: they stay or go together.
    Columns of ``df`` that have these names are replaced, all others stay; an empty table gives an empty result. Ids must
    be whole numbers, or text that reads as such. A content is held whole in a task, however long it is.
    """
    df = without(df, "text_sha256", "keep_id", "group_size", "kept")
    (longest,) = free_names(df, "keep_length")
    groups = exact_groups(df.select(id_col, text_col), text_col, id_col, bucket_bytes).withColumnRenamed("keep_length", longest)
    sha = F.sha2(normalized(F.col(text_col)).cast("binary"), 256)
    joined = df.withColumn("text_sha256", sha).join(groups, "text_sha256")
    kept = F.col(id_col).cast("long").eqNullSafe(F.col("keep_id")) & (F.length(F.coalesce(F.col(text_col), F.lit(""))) == F.col(longest))
    return joined.withColumn("kept", kept).drop(longest)


def exact_dedup_digest(docs: DataFrame) -> DataFrame:
    """The decisions alone. Only ids, digests and lengths go through the join, not the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.length(text).alias("n"), F.sha2(normalized(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    kept = F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_length"))
    return slim.join(exact_groups(docs.select("doc_id", "text")), "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
