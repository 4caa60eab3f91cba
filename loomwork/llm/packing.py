"""Order-preserving packing of documents into token sequences by dynamic programming.

The documents of a partition, in their order, make one stream of tokens. A sequence is a window of the stream; windows
end at document ends, at sentence ends or, where a sentence is long, at regular points inside it. The cost of a window is
its padding, plus a penalty for what its end cuts. With ``best(j) = min over i of best(i) + capacity - (pos(j) - pos(i)) + penalty(j)``
over the ``i`` within one capacity of ``j``, the minimum of ``best(i) + pos(i)`` over a sliding window is all that is needed: a
monotone queue gives it in constant time. A window of exactly a power of two tokens needs no padding at all.

Nothing is shuffled. A partition is worked off in blocks, so that a task holds a bounded part of the stream (or one
document); the last windows of a block are left to the next one.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import slices, small_batches

CAPACITY, END_ID = 2048, 1
#: Tokens of padding that a cut is worth: at a document's end, at a sentence's end, within a sentence.
AT_DOCUMENT, AT_SENTENCE, INSIDE = 0, 4, 40
#: What a window of fewer tokens than the capacity costs besides, though it needs no padding: else the stream crumbles.
SHORT = 32
#: Further points at which a longer sentence may be cut, in tokens.
STRIDE = 64
#: Tokens that are packed at a time.
BLOCK = 64 * CAPACITY
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass
class ByteBpe:
    """A byte-level BPE vocabulary as read from a tokenizer file: token bytes and ids, and the special tokens' texts and ids."""

    pattern: str
    ranks: dict[bytes, int]
    special: dict[str, int]
    source: str

    def encoder(self):
        """A function from a text to the ids that the file's own library gives it, where a special token's text is that token.

        The faster of two libraries with equal results refuses runs of a million blanks.
        """
        import tiktoken
        import tokenizers

        fast = tiktoken.Encoding("byte_bpe", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.special)
        whole = None

        def encode(text: str) -> np.ndarray:
            nonlocal whole
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                if whole is None:
                    whole = tokenizers.Tokenizer.from_str(self.source)
                return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        return encode

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each id whether its bytes end a sentence, and whether they begin with white space."""
        size = max(*self.ranks.values(), *self.special.values()) + 1
        ends, begins = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, k in self.ranks.items():
            ends[k] = token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?") or token.endswith(b"\n")
            begins[k] = token[:1].isspace()
        return ends, begins


def load_byte_bpe(path: str) -> ByteBpe:
    """Read a tokenizer file whose merges are in the order of their ids; its byte-to-character table is undone."""
    import public_tokenizers

    with open(path, encoding="utf-8") as file:
        source = file.read()
    model = json.loads(source)
    # printable Latin-1 characters stand for themselves, the other bytes for 256, 257 and so on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in model["model"]["vocab"].items() if k not in special.values()}
    return ByteBpe(public_tokenizers.PATTERN, ranks, special, source)


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, begins: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut (0 first, its end last) and what a cut there costs.

    ``doc_ends`` are the positions just after each document's last id; that id is the document's end mark.
    """
    stop = len(ids)
    cost = np.full(stop + 1, -1, dtype=np.int64)
    known = np.minimum(ids, len(ends) - 1)
    sentence = np.flatnonzero(ends[known[:-1]] & begins[known[1:]]) + 1 if stop > 1 else np.zeros(0, dtype=np.int64)
    cost[sentence] = AT_SENTENCE
    cost[doc_ends] = AT_DOCUMENT
    cost[[0, stop]] = AT_DOCUMENT
    have = np.flatnonzero(cost >= 0)
    for a, gap in zip(have[:-1][np.diff(have) > 2 * stride].tolist(), np.diff(have)[np.diff(have) > 2 * stride].tolist(), strict=True):
        cost[a + stride : a + gap : stride] = INSIDE
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The positions, from 0 to the end, at which the cheapest division into windows of at most ``capacity`` cuts."""
    count = len(at)
    exact: dict[int, list[int]] = {}  # windows of a power of two tokens
    size = capacity // 2
    while size:
        first = np.searchsorted(at, at - size)
        ok = at[np.minimum(first, count - 1)] == at - size
        for j in np.flatnonzero(ok).tolist():
            exact.setdefault(j, []).append(int(first[j]))
        size //= 2
    pos, pen = at.tolist(), penalty.tolist()
    best, back = [0] * count, [0] * count
    queue: deque[int] = deque([0])  # indices by position, with rising best + pos
    for j in range(1, count):
        here = pos[j]
        while pos[queue[0]] < here - capacity:
            queue.popleft()
        i = queue[0]
        cost = best[i] + pos[i] + capacity - here
        for k in exact.get(j, ()):
            if best[k] + SHORT < cost:
                i, cost = k, best[k] + SHORT
        best[j], back[j] = cost + pen[j], i
        key = best[j] + here
        while queue and best[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [pos[-1]], count - 1
    while j:
        j = back[j]
        cuts.append(pos[j])
    return cuts[::-1]


def _binary(start: int, stop: int, capacity: int) -> list[int]:
    """The ends of windows of powers of two tokens, largest first, if that spares padding; else ``stop`` alone."""
    length = stop - start
    sizes = [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]
    if capacity - length <= INSIDE * (len(sizes) - 1):
        return [stop]
    return (start + np.cumsum(sizes)).tolist()


class _Stream:
    """The part of a partition's stream that isn't packed yet."""

    def __init__(self, ends: np.ndarray, begins: np.ndarray, capacity: int):
        self.ends, self.begins, self.capacity, self.base, self.sequence = ends, begins, capacity, 0, 0
        self.docs: deque[list] = deque()  # id, tokens, ids yet to be packed, how many were packed before
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids), ids, 0])
        self.waiting += len(ids)

    def pack(self, partition: int, last: bool) -> Iterator[tuple]:
        """Pieces of all windows, but for the last few unless the stream ends."""
        if not self.docs:
            return
        ids = np.concatenate([d[2] for d in self.docs])
        at, penalty = cut_points(ids, np.cumsum([len(d[2]) for d in self.docs]), self.ends, self.begins)
        cuts = best_cuts(at, penalty, self.capacity)
        if last:
            cuts = [*cuts[:-1], *_binary(cuts[-2], cuts[-1], self.capacity)]
        else:
            keep = self.waiting - 4 * self.capacity
            cuts = [c for c in cuts if c <= keep] or [0]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            offset, need = 0, stop - start
            while need:
                doc = self.docs[0]
                take = min(need, len(doc[2]))
                piece = doc[2][:take]
                yield doc[0], doc[3], take, piece.astype("<u4").tobytes(), doc[1], (partition << 40) + self.sequence, offset
                doc[2], doc[3] = doc[2][take:], doc[3] + take
                offset, need = offset + take, need - take
                if not len(doc[2]):
                    self.docs.popleft()
            self.sequence += 1
        self.waiting -= cuts[-1]


def pack_documents(df: DataFrame, bpe: ByteBpe, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document's ids are those of its whole text, as the tokenizer file's library gives them, then ``end_id``; the text of
    a special token is that token. ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers; pieces of a sequence follow each other
    from offset 0 without gaps and in the order of the partition's rows, so ``df`` should give its rows in a
    repeatable order, as files do. A sequence lies within one partition, whose number is in the upper bits of
    ``sequence_id``. Null and empty texts have the end mark alone; null ids stay null; repeated rows are packed each;
    an empty table gives an empty result; other columns are ignored. Ids must be whole numbers, or text that reads as
    such. A document's ids are held whole in a task, however long it is. ``capacity`` is a power of two.
    """
    held = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (ends, begins) = held.value.encoder(), held.value.tables()
        stream, partition = _Stream(ends, begins, capacity), TaskContext.get().partitionId()

        def rows(last: bool) -> pa.RecordBatch:
            found = list(zip(*stream.pack(partition, last), strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                stream.add(doc_id, np.append(encode(text) if text else np.zeros(0, dtype=np.uint32), np.uint32(end_id)))
                if stream.waiting >= block:
                    yield rows(False)
        yield rows(True)

    slim = small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def packing_digest(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    return pack_documents(docs, bpe).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
