"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are tagged "toxic" or "other". A word's features are itself, its beginnings and endings, and its neighbours, all
hashed into one table of weights; the chain adds weights for what follows what. Forward-backward gives each word's
marginal probability; a document's score is a logistic function of the largest marginal and of their sum, and its
offending offsets are the runs of words whose marginal is at least one half.

Labels are of documents, so words are labelled first: those of toxic documents that have a feature which many toxic
and hardly any clean documents have; near copies count as one document there. Everything is learned on the driver from
a bounded number of labelled rows, whole texts of any length; every document is then scored where it lies, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.language_id import held_out
from loomwork.llm.shared import SpanHasher, mix, slices, small_batches, window_hashes

#: Labelled documents to learn from at most, of either label.
PER_LABEL = 1_200
#: And so many bytes of text of each label at most.
LABEL_BYTES = 10 << 20
TABLE = 1 << 21
PREFIXES, SUFFIXES = (2, 3, 4, 5, 6, 7, 8), (3, 4)
#: A feature marks toxic words if at least this share of the toxic documents has it (and so many), and this many times the share of the clean ones.
MIN_SHARE, MIN_DOCS, LIFT = 0.01, 4, 50
STEP = 256
#: Bytes of words: letters, digits and all that is not ASCII.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _lower(text: str) -> bytes:
    """Lower case in which every character keeps its place in bytes."""
    lowered = text.lower().encode("utf-8", "replace")
    if len(lowered) == len(text.encode("utf-8", "replace")):
        return lowered
    return "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text).encode("utf-8", "replace")


class Tokens:
    """The words of some texts and their features' places in the table."""

    def __init__(self, texts: list[str | None]):
        parts = [_lower(t) if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], _INSIDE[data].view(np.int8), [0]])))
        self.starts, self.stops = edge[::2], edge[1::2]
        self._begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        self.text = np.searchsorted(self._begin, self.starts, side="right") - 1
        self.first = np.concatenate([[True], self.text[1:] != self.text[:-1]])[: len(self.text)]
        self._hash, self._data = SpanHasher(data), data
        self.words = self._hash(self.starts, self.stops)

    def columns(self) -> Iterator[np.ndarray]:
        """Each word's place for one feature after the other: the word, its beginnings, its endings, and its neighbours."""
        size = self.stops - self.starts
        yield self._place(self.words, 0)
        for k in PREFIXES:
            yield np.where(size >= k, self._place(self._hash(self.starts, np.minimum(self.stops, self.starts + k)), k), 0)
        for k in SUFFIXES:
            yield np.where(size >= k, self._place(self._hash(np.maximum(self.starts, self.stops - k), self.stops), 16 + k), 0)
        yield np.where(self.first, 1, self._place(np.roll(self.words, 1), 32))
        yield np.where(np.roll(self.first, -1), 2, self._place(np.roll(self.words, -1), 33))

    def emission(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words))
        for column in self.columns():
            out += weights[column]
        return out

    @staticmethod
    def _place(hashes: np.ndarray, kind: int) -> np.ndarray:
        """0 stands for no feature, 1 and 2 for a text's ends."""
        return (mix(hashes + np.uint64(kind)) % np.uint64(TABLE - 8)).astype(np.int64) + 8

    def offsets(self, at: np.ndarray) -> np.ndarray:
        """Bytes to characters of the text that they lie in."""
        chars = np.concatenate([[0], np.cumsum((self._data & 0xC0) != 0x80)])
        return chars[at] - chars[self._begin[np.searchsorted(self._begin, at, side="right") - 1]]


@dataclass
class Chain:
    """Log weights of the first word's tag and of tag after tag."""

    start: np.ndarray
    follow: np.ndarray

    def run(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's probability of being toxic, and of each pair of tags at it and before it (rows are the tag before).

        The words of all texts form one chain that forgets what was at each text's first word. It is cut into blocks that
        advance together: their matrix products are chained, and give each block's incoming messages.
        """
        count = len(emission)
        blocks = -(-count // STEP)
        weight = np.exp(np.clip(emission, -30, 30))
        m = np.empty((4, blocks * STEP))  # from other to other, other to toxic, toxic to other, toxic to toxic
        m[:, count:] = np.array([1.0, 0.0, 0.0, 1.0])[:, None]
        start, follow = np.exp(self.start), np.exp(self.follow)
        for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            m[k, :count] = np.where(first, start[j], follow[i, j]) * (weight if j else 1.0)
        m = np.ascontiguousarray(m.reshape(4, blocks, STEP).transpose(0, 2, 1))
        product = np.stack([np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)])
        for t in range(STEP):
            a, b, c, d = product
            w, x, y, z = m[:, t]
            product = np.stack([a * w + b * y, a * x + b * z, c * w + d * y, c * x + d * z])
            product /= product.sum(axis=0)
        ahead, behind = np.empty((2, blocks)), np.empty((2, blocks))
        u = v = 0.5
        for b in range(blocks):
            ahead[:, b] = u, v
            p = product[:, b]
            u, v = u * p[0] + v * p[2], u * p[1] + v * p[3]
            u, v = u / (u + v), v / (u + v)
        u = v = 0.5
        for b in range(blocks - 1, -1, -1):
            behind[:, b] = u, v
            p = product[:, b]
            u, v = p[0] * u + p[1] * v, p[2] * u + p[3] * v
            u, v = u / (u + v), v / (u + v)
        alpha, beta = np.empty((STEP + 1, 2, blocks)), np.empty((STEP, 2, blocks))
        alpha[0] = ahead
        for t in range(STEP):
            u, v = alpha[t]
            w, x, y, z = m[:, t]
            u, v = u * w + v * y, u * x + v * z
            total = u + v
            alpha[t + 1, 0], alpha[t + 1, 1] = u / total, v / total
        beta[-1] = behind
        for t in range(STEP - 1, 0, -1):
            u, v = beta[t]
            w, x, y, z = m[:, t]
            u, v = w * u + x * v, y * u + z * v
            total = u + v
            beta[t - 1, 0], beta[t - 1, 1] = u / total, v / total
        pair = np.stack([alpha[:-1, i] * m[2 * i + j] * beta[:, j] for i in (0, 1) for j in (0, 1)])
        pair = (pair / pair.sum(axis=0)).transpose(0, 2, 1).reshape(4, -1)[:, :count]
        return pair[1] + pair[3], pair


@dataclass
class ToxicityModel:
    """``weights`` by feature, the chain, and the logistic function of (1, largest marginal, log of 1 + their sum)."""

    weights: np.ndarray
    chain: Chain
    scale: np.ndarray

    def tag(self, texts: list[str | None]) -> tuple[Tokens, np.ndarray]:
        tokens = Tokens(texts)
        if not len(tokens.words):
            return tokens, np.zeros(0)
        return tokens, self.chain.run(tokens.emission(self.weights), tokens.first)[0]

    def score(self, tokens: Tokens, marginal: np.ndarray, count: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_summary(tokens, marginal, count) @ self.scale, -500, 500)))


def _summary(tokens: Tokens, marginal: np.ndarray, count: int) -> np.ndarray:
    largest = np.zeros(count)
    np.maximum.at(largest, tokens.text, marginal)
    total = np.bincount(tokens.text, weights=np.where(marginal >= 0.2, marginal, 0), minlength=count)
    return np.stack([np.ones(count), largest, np.log1p(total)], axis=1)


def copy_groups(texts: list[str], width: int = 3, draws: int = 8) -> np.ndarray:
    """A number for each text; texts that share three of eight minima of hashed word triples with an earlier one have its number."""
    seen: dict[tuple[int, int], list[int]] = {}
    group = np.arange(len(texts))
    for k, text in enumerate(texts):
        words = Tokens([text]).words
        grams = window_hashes(words, width) if len(words) >= width else words
        keys = [(d, int(mix(grams + np.uint64(d)).min())) for d in range(draws)] if len(grams) else []
        shared = [j for key in keys for j in seen.get(key, ())]
        if shared:
            texts_of, times = np.unique(shared, return_counts=True)
            if times.max() >= 3:
                group[k] = texts_of[times.argmax()]
                continue
        for key in keys:
            seen.setdefault(key, []).append(k)
    return group


def _sides(group: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows train the chain and which fit the logistic function: every fifth group, else every fifth row; all for both where labels are too few."""
    rows = np.arange(len(group))
    for test in (np.cumsum(group == rows)[group] % 5 == 1, rows % 5 == 0):
        if len(np.unique(y[test])) == len(np.unique(y[~test])) == 2:
            return ~test, test
    return rows >= 0, rows >= 0


class Sample:
    """The words of labelled texts, as a list of feature columns, a few texts at a time lest all hashes are held at once."""

    def __init__(self, texts: list[str], size: int = 1 << 20):
        self.count, columns, text, first, start = len(texts), [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)], 0
        while start < len(texts):
            stop, room = start + 1, size - len(texts[start])
            while stop < len(texts) and len(texts[stop]) <= room:
                room -= len(texts[stop])
                stop += 1
            tokens = Tokens(texts[start:stop])
            columns.append([c.astype(np.int32) for c in tokens.columns()])
            text.append(tokens.text + start)
            first.append(tokens.first)
            start = stop
        self.text, self.first = np.concatenate(text), np.concatenate(first)
        self.columns = [np.concatenate(c) for c in zip(*columns, strict=True)] or [np.zeros(0, dtype=np.int32)] * (len(PREFIXES) + len(SUFFIXES) + 3)


def label_words(sample: Sample, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which words of the toxic documents count as toxic: those with a feature that marks toxic documents. ``weight`` is a document's share."""
    own = [sample.columns[k] for k in (0, *range(2, len(PREFIXES) + 1))]  # two bytes are too few to tell
    held, clean = np.zeros(TABLE), np.zeros(TABLE)
    for column in own:
        pairs = np.unique(sample.text * TABLE + column)
        text, place = pairs // TABLE, pairs % TABLE
        held += np.bincount(place, weights=weight[text] * toxic[text], minlength=TABLE)
        clean += np.bincount(place, weights=weight[text] * ~toxic[text], minlength=TABLE)
    n_toxic, n_clean = max(1.0, weight[toxic].sum()), max(1.0, weight[~toxic].sum())
    marks = (held >= np.maximum(MIN_DOCS, MIN_SHARE * n_toxic) - 1e-9) & (clean / n_clean * LIFT <= held / n_toxic)
    marks[:8] = False
    found = np.zeros(len(sample.text), dtype=bool)
    for column in own:
        found |= marks[column]
    return found & toxic[sample.text]


def train_crf(sample: Sample, tags: np.ndarray, rounds: int = 25, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, Chain]:
    """Weights that maximise the tags' likelihood, by gradient steps scaled with their history."""
    seen = np.zeros(TABLE, dtype=bool)
    for column in sample.columns:
        seen[column] = True
    used = np.flatnonzero(seen)
    rank = np.zeros(TABLE, dtype=np.int32)
    rank[used] = np.arange(len(used))
    columns, first = [rank[c] for c in sample.columns], sample.first
    weights, chain, count = np.zeros(len(used)), Chain(np.array([0.0, -4.0]), np.array([[0.0, -4.0], [0.0, -2.0]])), len(tags)
    history, chain_history = np.full(len(used), 1e-8), np.full(6, 1e-8)
    before = np.roll(tags, 1)
    observed = np.array([(~first & (before == i) & (tags == j)).sum() for i in (0, 1) for j in (0, 1)] + [(first & (tags == j)).sum() for j in (0, 1)])
    for _ in range(rounds):
        emission = np.zeros(count)
        for column in columns:
            emission += weights[column]
        p, pair = chain.run(emission, first)
        gradient, miss = decay * weights, (p - tags) / count
        for column in columns:
            gradient += np.bincount(column, weights=miss, minlength=len(used))
        history += gradient**2
        weights -= rate * gradient / np.sqrt(history)
        inner = pair[:, ~first].sum(axis=1)
        at_first = p[first].sum()
        expected = np.concatenate([inner, [first.sum() - at_first, at_first]])
        step = (expected - observed) / count
        chain_history += step**2
        step = rate * 0.2 * step / np.sqrt(chain_history)
        chain = Chain(chain.start - step[4:], chain.follow - step[:4].reshape(2, 2))
    table = np.zeros(TABLE, dtype=np.float32)
    table[used] = weights
    return table, chain


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small quadratic penalty; ``weight`` says how much each row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


def _within(rows: list, most: int) -> list:
    """Of (id, label, bytes) in order the ids whose bytes together stay within ``most`` for their label; a text that doesn't fit is passed over."""
    room, kept = {0: most, 1: most}, []
    for row in rows:
        if row["bytes"] <= room[row["label"]]:
            room[row["label"]] -= row["bytes"]
            kept.append(row["_id"])
    return kept


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_label: int = PER_LABEL, label_bytes: int = LABEL_BYTES) -> ToxicityModel:
    """Learn from ``labels`` (id and 0 or 1) of ``docs``: of each label ``per_label`` rows and ``label_bytes`` of text at most, by the hash of their id.

    Whole texts of these rows are used: the driver holds them and some sixty bytes a word. A text that alone has more
    than ``label_bytes`` isn't learnt from. Four fifths train the chain, the rest (near copies lie on one side) fits the
    logistic function, in which the labels weigh as they occur among all labelled rows. Of several texts of an id the
    first in order counts, of several labels the larger. Without both labels every score is the labels' mean (0 if there
    are none).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]).groupBy("_id").agg(F.max("_label").alias("_label")))  # 2 * per_label rows at most
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    order = [F.xxhash64(F.lit(1), "_id"), F.col("_id")]
    # sizes first: which texts the driver may hold is told by 2 * per_label numbers
    sizes = usable.join(chosen, "_id").groupBy("_id").agg(F.first("_label").alias("label"), F.max(F.octet_length("_text")).alias("bytes")).orderBy(*order).collect()
    fitting = labels.sparkSession.createDataFrame([(k,) for k in _within(sizes, label_bytes)], known.select("_id").schema)
    rows = usable.join(chosen.join(F.broadcast(fitting), "_id", "left_semi"), "_id").groupBy("_id").agg(F.min("_text").alias("text"), F.first("_label").alias("label"))
    rows = rows.orderBy(*order).select("text", "label").toArrow()
    texts, y = rows["text"].to_pylist(), rows["label"].to_numpy() == 1
    if not len(y) or y.all() or not y.any():
        mean = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(np.zeros(TABLE, dtype=np.float32), Chain(np.array([0.0, -30.0]), np.array([[0.0, -30.0], [0.0, -30.0]])), np.array([np.log(mean + 1e-9) - np.log(1 - mean + 1e-9), 0, 0]))
    group = copy_groups(texts)
    share = 1 / np.bincount(group, minlength=len(group))[group]
    train, test = _sides(group, y)
    sample = Sample([t for t, x in zip(texts, train, strict=True) if x])
    weights, chain = train_crf(sample, label_words(sample, y[train], share[train]).astype(np.int64))
    model = ToxicityModel(weights, chain, np.zeros(3))
    # texts one by one, as a long one needs its own room
    summary = np.concatenate([_summary(*model.tag([t]), 1) for t, x in zip(texts, test, strict=True) if x])
    own = y[test]
    weight = np.where(own, totals[1] / max(1, own.sum()), totals[0] / max(1, (~own).sum()))
    model.scale = _logistic(summary, own.astype(np.float64), weight / weight.mean())
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", into: str = "toxicity", threshold: float = 0.5) -> DataFrame:
    """``df`` with a column ``into``: a struct of ``score`` (0 to 1) and ``spans`` (start, end, probability).

    Spans are runs of neighbouring words whose marginals reach ``threshold``, as offsets in characters of the text, with
    the largest marginal. Null, empty and wordless texts have no spans and the score of a text in which nothing was
    found. Other columns and repeated rows stay as they are (a column named ``into`` is replaced); an empty table gives
    an empty result. A text is one chain, worked off whole in one task in memory of some two hundred bytes a word.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])
        for texts in batches:
            scores, spans = [np.zeros(0)], []
            for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
                tokens, marginal = held.value.tag(part.column("text").to_pylist())
                scores.append(held.value.score(tokens, marginal, part.num_rows))
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                at = np.flatnonzero(marginal >= threshold)
                starts, stops = tokens.offsets(tokens.starts[at]).tolist(), tokens.offsets(tokens.stops[at] - 1).tolist()
                for k, (word, a, b) in enumerate(zip(at.tolist(), starts, stops, strict=True)):
                    own = found[tokens.text[word]]
                    if k and at[k - 1] == word - 1 and not tokens.first[word]:
                        own[-1] |= {"end": b + 1, "probability": max(own[-1]["probability"], float(marginal[word]))}
                    else:
                        own.append({"start": a, "end": b + 1, "probability": float(marginal[word])})
                spans += found
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(spans, pa.list_(kind))], names=["score", "spans"])

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    result = "score double, spans array<struct<start: int, end: int, probability: double>>"
    # called nondeterministic only lest uses of several fields make Spark judge several times
    return small_batches(df).withColumn(into, F.arrow_udf(judge, result).asNondeterministic()(F.col(text_col)))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = held_out(folds=5, fold=0)
    model = fit_toxicity(docs.where(~out), labels.where(~out))
    score = F.col("toxicity.score")
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))
