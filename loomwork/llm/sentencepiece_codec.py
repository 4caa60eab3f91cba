"""SentencePiece encoding and decoding, batched in numpy.

A text is normalised as the model asks (spaces become U+2581, one is put before the text) and cut before every U+2581 that
follows something else; no piece goes over such a cut, so that a text's division is made of the divisions of its units.
Each distinct unit of a batch is divided once. Units of equal length advance together, and substrings are found by their
hashes among the sorted keys of the pieces. A character that no piece covers becomes its bytes.

Two ways of dividing, by the kind of model:

- unigram models: Viterbi. For every end and every length of a piece vectorised maxima keep the best sum of scores and a
  back pointer; ties go to the shorter last piece.
- merge models (whose scores are the ranks of merges, hence whole numbers): the best sum of ranks isn't the division that
  the model stands for, so that Viterbi gives wrong ids. Here units of equal length make one merge each per round: the
  pair whose joined piece has the best score, the leftmost of equals; all that go on have equally many symbols.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import SpanHasher, slices, small_batches

SPACE = "▁"
#: What a character that no piece covers costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Units of more characters are merged one by one.
LONG = 96
#: Distinct units whose division a task remembers at most.
REMEMBERED = 500_000
_ENCODERS: dict[int, Encoder] = {}  # of a worker process, which goes on to further tasks


class Codes:
    """Characters as numbers, and two independent hashes of their substrings."""

    def __init__(self, text: str):
        self.text = text
        self.values = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        self.key, self.check = SpanHasher(self.values), SpanHasher(self.values, seed=1)

    def __len__(self) -> int:
        return len(self.values)


@dataclass
class PieceModel:
    """Pieces by id, their scores, and which of them are ordinary; ``byte_ids[b]`` is the piece of byte b, -1 if there is none."""

    pieces: list[str]
    scores: np.ndarray
    ordinary: np.ndarray
    byte_ids: np.ndarray
    unknown: int

    def __post_init__(self):
        ids = np.flatnonzero(self.ordinary)
        ends = np.cumsum([len(self.pieces[k]) for k in ids])
        starts = ends - [len(self.pieces[k]) for k in ids]
        codes = Codes("".join(self.pieces[k] for k in ids))
        keys = codes.key(starts, ends)
        order = np.argsort(keys)
        self.keys, self.ids, self.check = keys[order], ids[order], codes.check(starts, ends)[order]
        self.digest = hash((tuple(self.pieces), self.scores.tobytes()))
        self.by_text = {self.pieces[k]: int(k) for k in ids}
        self.longest = int((ends - starts).max())
        self.floor = float(self.scores[ids].min()) - UNKNOWN_PENALTY

    @property
    def merges(self) -> bool:
        """Whether the scores are ranks of merges."""
        scores = self.scores[self.ordinary]
        return bool((scores == np.round(scores)).all())

    def look_up(self, codes: Codes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The piece of each substring, -1 if there is none; two hashes must agree."""
        keys = codes.key(starts, stops)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        hit = hit[self.check[at[hit]] == codes.check(starts[hit], stops[hit])]
        found = np.full(len(starts), -1, dtype=np.int64)
        found[hit] = self.ids[at[hit]]
        return found


def load_pieces(path: str) -> PieceModel:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = range(model.get_piece_size())
    special = np.array([model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k) for k in count])
    byte_ids = np.full(256, -1, dtype=np.int64)
    for k in count:
        if model.is_byte(k):
            byte_ids[int(model.id_to_piece(k)[3:5], 16)] = k
    return PieceModel([model.id_to_piece(k) for k in count], np.array([model.get_score(k) for k in count]), ~special, byte_ids, model.unk_id())


def normalise(text: str) -> str:
    """White space as U+2581, and one before the text; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _advance(model: PieceModel, codes: Codes, starts: np.ndarray, length: int) -> np.ndarray:
    """Back pointers of units of one length: at ``[unit, end]`` the size of the last piece of the best division up to there."""
    best = np.full((len(starts), length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((len(starts), length + 1), dtype=np.int32)
    for end in range(1, length + 1):
        for size in range(1, min(end, model.longest) + 1):  # of equal sums the shorter last piece stays
            piece = model.look_up(codes, starts + end - size, starts + end)
            score = np.where(piece >= 0, model.scores[piece], model.floor if size == 1 else -np.inf)
            total = best[:, end - size] + score
            better = total > best[:, end]
            best[better, end] = total[better]
            back[better, end] = size
    return back


def _viterbi(model: PieceModel, codes: Codes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best division of units of one length: for each piece its unit, where it starts in it, and its size."""
    back = _advance(model, codes, starts, length)
    unit, end, found = np.arange(len(starts)), np.full(len(starts), length), []
    while len(unit):
        size = back[unit, end]
        found.append((unit, end - size, size))
        end = end - size
        unit, end = unit[end > 0], end[end > 0]
    unit, at, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, unit))
    return unit[order], at[order], size[order]


def _pair_scores(model: PieceModel, codes: Codes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    piece = model.look_up(codes, starts, stops)
    return np.where(piece >= 0, model.scores[piece], -np.inf)


def _merge(model: PieceModel, codes: Codes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of one length merged in rounds; the same answer as ``_viterbi`` gives. ``edge`` has where each unit's symbols begin and end."""
    unit = np.arange(len(starts))
    edge = np.tile(np.arange(length + 1), (len(starts), 1))
    score = _pair_scores(model, codes, (starts[:, None] + edge[:, :-2]).ravel(), (starts[:, None] + edge[:, 2:]).ravel()).reshape(len(starts), length - 1)
    found = []

    def finish(done: np.ndarray) -> None:
        symbols = edge.shape[1] - 1
        found.append((np.repeat(unit[done], symbols), edge[done, :-1].ravel(), np.diff(edge[done], axis=1).ravel()))

    while len(unit):
        best = score.argmax(axis=1) if score.shape[1] else np.zeros(len(unit), dtype=np.int64)
        goes_on = score[np.arange(len(unit)), best] > -np.inf if score.shape[1] else np.zeros(len(unit), dtype=bool)
        if not goes_on.all():
            finish(~goes_on)
            unit, edge, score, best = unit[goes_on], edge[goes_on], score[goes_on], best[goes_on]
        if not len(unit):
            break
        row = np.arange(len(unit))
        edge = edge[np.arange(edge.shape[1]) != best[:, None] + 1].reshape(len(unit), -1)
        score = score[np.arange(score.shape[1]) != best[:, None]].reshape(len(unit), -1)
        for side in (best - 1, best):  # the pairs on either side of the new symbol
            mine = np.flatnonzero((side >= 0) & (side < score.shape[1]))
            begin = starts[unit[mine]]
            score[mine, side[mine]] = _pair_scores(model, codes, begin + edge[row[mine], side[mine]], begin + edge[row[mine], side[mine] + 2])
    unit, at, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, unit))
    return unit[order], at[order], size[order]


def _merge_long(model: PieceModel, text: str) -> list[int]:
    """Sizes of the symbols of one long unit: a heap of pairs, as rounds over all of its symbols would take too long."""
    size, after, before = [1] * len(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(at: int) -> None:
        if 0 <= at and after[at] < len(text):
            whole = size[at] + size[after[at]]
            piece = model.by_text.get(text[at : at + whole])
            if piece is not None:
                heapq.heappush(heap, (-model.scores[piece], at, whole))

    for at in range(len(text) - 1):
        offer(at)
    while heap:
        _, at, whole = heapq.heappop(heap)
        if not size[at] or after[at] >= len(text) or size[at] + size[after[at]] != whole:
            continue  # one of the two has been merged since
        gone = after[at]
        size[at], size[gone], after[at] = whole, 0, after[gone]
        if after[at] < len(text):
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [x for x in size if x]


def _divide(model: PieceModel, codes: Codes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of units of one length, in order, and of which unit each is."""
    if not model.merges:
        unit, at, size = _viterbi(model, codes, starts, length)
    elif length <= LONG:
        unit, at, size = _merge(model, codes, starts, length)
    else:
        sizes = [_merge_long(model, codes.text[s : s + length]) for s in starts]
        unit, size = np.repeat(np.arange(len(starts)), [len(x) for x in sizes]), np.concatenate(sizes)
        at = np.concatenate([np.cumsum(x) - x for x in sizes])
    begin = starts[unit] + at
    ids = model.look_up(codes, begin, begin + size)
    missing = np.flatnonzero(ids < 0)
    if not len(missing):
        return ids, unit
    spelled = {int(k): _spell(model, chr(codes.values[begin[k]])) for k in missing}
    count = np.ones(len(ids), dtype=np.int64)
    count[missing] = [len(spelled[int(k)]) for k in missing]
    first = np.cumsum(count) - count
    out = np.repeat(ids, count)
    for k in missing.tolist():
        out[first[k] : first[k] + count[k]] = spelled[k]
    return out, np.repeat(unit, count)


def _spell(model: PieceModel, char: str) -> list[int]:
    ids = [int(model.byte_ids[b]) for b in char.encode("utf-8", "replace")]
    return ids if min(ids) >= 0 else [model.unknown]


class Encoder:
    """Encodes texts and remembers how units were divided."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks, self.begin, self.count, self.ids = *(np.zeros(0, dtype=np.uint64) for _ in range(2)), *(np.zeros(0, dtype=np.int64) for _ in range(3))

    def _learn(self, codes: Codes, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        """Divide new units and keep the answers."""
        ids, owner = [], []
        for length in np.unique(size):
            of = np.flatnonzero(size == length)
            block = max(1, (1 << 20) // int(length + 1))  # so many at a time, so that the tables of a length stay small
            for k in range(0, len(of), block):
                got, unit = _divide(self.model, codes, starts[of[k : k + block]], int(length))
                ids.append(got)
                owner.append(of[k : k + block][unit])
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=len(keys))
        begin = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, np.concatenate(ids)[order]])
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged)
        self.keys, self.checks = merged[order], np.concatenate([self.checks, checks])[order]
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        marked = [normalise(t or "") for t in texts]
        codes, ends = Codes("".join(marked)), np.cumsum([len(m) for m in marked]).astype(np.int64)
        if not len(codes):
            return [np.zeros(0, dtype=np.int64) for _ in texts]
        begins = codes.values == ord(SPACE)
        begins[1:] &= ~begins[:-1]
        firsts = ends - [len(m) for m in marked]
        begins[firsts[firsts < len(codes)]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(codes))
        keys, first, which = np.unique(codes.key(starts, stops), return_index=True, return_inverse=True)
        checks = codes.check(starts, stops)
        clash = bool((checks != checks[first][which]).any())
        if clash:  # different units have one key: each unit stands for itself, and nothing is remembered
            keys, first, which, checks = np.arange(len(starts), dtype=np.uint64), np.arange(len(starts)), np.arange(len(starts)), np.zeros(len(starts), dtype=np.uint64)
            self._forget()
        checks = checks[first]
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        if len(self.keys) + len(keys) > REMEMBERED or (self.checks[at[known]] != checks[known]).any():
            self._forget()
            known[:] = False
        if not known.all():
            new = first[~known]
            self._learn(codes, keys[~known], checks[~known], starts[new], (stops - starts)[new])
            at = np.searchsorted(self.keys, keys)
        begin, times = self.begin[at][which], self.count[at][which]
        ids = self.ids[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)]
        if clash:
            self._forget()
        of_text = np.searchsorted(ends, starts, side="right")
        return np.split(ids, np.cumsum(np.bincount(of_text, weights=times, minlength=len(texts)).astype(np.int64))[:-1])


class Decoder:
    """Texts of ids: pieces joined, byte pieces read as UTF-8, U+2581 as space, less the one before the text."""

    def __init__(self, model: PieceModel):
        parts = [p.encode() if o else b"" for p, o in zip(model.pieces, model.ordinary, strict=True)]
        for b, k in enumerate(model.byte_ids):
            if k >= 0:
                parts[k] = bytes([b])
        parts[model.unknown] = " ⁇ ".encode()
        self.size = np.array([len(p) for p in parts])
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def __call__(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        size = self.size[ids]
        at = np.arange(size.sum()) + np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.bytes[at].tobytes().decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


def encode_texts(df: DataFrame, model: PieceModel, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with ``into``, the ids of each whole text as ``array<int>``.

    Null and empty texts have no ids; a text is encoded whole in one task, in memory of some hundred bytes a character. U+2581 in a text can't be told from a space afterwards, as in the model's own
    library. A column named ``into`` is replaced; repeated rows stay; an empty table gives an empty result.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        if model.digest not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[model.digest] = Encoder(model)
        encode = _ENCODERS[model.digest]
        for texts in batches:
            found, sizes = [np.zeros(0, dtype=np.int64)], []
            for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
                ids = encode(part.column("text").to_pylist())
                sizes += [len(x) for x in ids]
                found += ids
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return small_batches(df).withColumn(into, F.arrow_udf(run, "array<int>").asNondeterministic()(F.col(text_col)))


def decode_ids(df: DataFrame, model: PieceModel, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with ``into``, the text of each row's ids; null ids give a null text."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = Decoder(held.value)
        for ids in batches:
            values, starts = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
            known = ids.is_valid().to_pylist()
            yield pa.array([read(values[starts[k] : starts[k + 1]]) if ok else None for k, ok in enumerate(known)], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return small_batches(df).withColumn(into, F.arrow_udf(run, "string").asNondeterministic()(F.col(ids_col)))


def sentencepiece_digest(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Per document the number of ids, a checksum of them, and whether decoding restores the text."""
    found = decode_ids(encode_texts(docs.select("doc_id", "text"), model), model)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
