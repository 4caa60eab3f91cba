"""Helpers that several operators share: lineage cuts, batch slicing, word spans and rolling hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in orderings and joins, so that null ids sort first and match each other.
NULL_ID = -(2**63)
#: A task's memory is some tens of times this.
BATCH = "4m"
_PRIME, _BITS = np.uint64(2**31 - 1), np.uint64(31)
_BASES = (0x1E3779B9, 0x42B2AE3D, 0x27D4EB4F, 0x165667B1)  # two for each seed
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in ``spark.checkpoint.dir``; a temporary one serves local masters only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from reliable storage: a lost executor costs no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` from Parquet in the shared folder, for many rows that several parts of a plan read."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_small(df: DataFrame, rows: int = 100_000, size: int = 16 << 20) -> DataFrame:
    """``df`` (whose rows are stored) marked for broadcasting if it was measured to have so few rows and bytes of text; else as it is, and Spark shuffles."""
    texts = [F.length(F.col(c).cast("binary")) for c, kind in df.dtypes if kind in ("string", "binary")]
    found = df.agg(F.count("*").alias("n"), *(F.sum(t).alias(f"t{k}") for k, t in enumerate(texts))).first()
    return F.broadcast(df) if found["n"] <= rows and sum(x or 0 for x in found[1:]) <= size else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator's own ones of these names (in any case) are to replace."""
    return df.drop(*(c for c in df.columns if c.lower() in names))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def id_order(column: str = "doc_id"):
    """A non-null long by which documents are ordered and joined; null ids come first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after Spark was told to pass texts to Python in batches of ``BATCH`` at most, unless the user has set another bound."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(key).lower() in ("67108864b", "64mb", "64m"):
        spark.conf.set(key, BATCH)
    return df


def slices(batches, column: str, max_bytes: int = 1 << 20):
    """Arrow record batches cut so that ``column`` holds about ``max_bytes`` each, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total, first = np.cumsum(byte_sizes(batch.column(column))), 0
        while first < batch.num_rows:
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
            yield batch.slice(first, last - first)
            first = last


def byte_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offset of each text in them (one more than there are texts). Nulls are empty."""
    sizes = byte_sizes(column)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(x for x in column.cast(pa.binary()).to_pylist() if x)
    return np.frombuffer(joined, dtype=np.uint8), offsets


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (one more than there are texts).

    Words are maximal runs of bytes other than space and 09-0D, or than those marked in ``blank``; a word never crosses
    two texts.
    """
    inside = ~(IS_SPACE[data] if blank is None else blank)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``base`` and of its inverse modulo the prime."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < size:
        size, prime = max(size, 1 << 16), int(_PRIME)

        def run(b: int) -> np.ndarray:
            out = np.ones(size, dtype=np.uint32)
            done = 1
            while done < size:  # what is known, times the power that comes next
                more = min(done, size - done)
                out[done : done + more] = out[:more].astype(np.uint64) * np.uint64(pow(b, done, prime)) % _PRIME
                done += more
            return out

        have = _POWERS[base] = (run(base), run(pow(base, -1, prime)))
    return have[0][:size], have[1][:size]


def _fold(x: np.ndarray) -> np.ndarray:
    """Smaller numbers of the same remainder modulo the prime 2**31 - 1."""
    return (x & _PRIME) + (x >> _BITS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """62-bit polynomial hashes of spans of ``values`` from prefix sums, modulo a prime and to two bases; equal contents hash alike.

    Of 64-bit values each base takes other bits; others are to be less than 2**31 - 1.
    """

    def __init__(self, values: np.ndarray, seed: int = 0):
        self.lanes, step = [], 1 << 14  # in parts that stay in a processor's cache
        for lane in (0, 1):
            power, inverse = _powers(_BASES[2 * seed + lane], len(values) + 1)
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            for k in range(0, len(values), step):
                part = values[k : k + step]
                own = (part >> np.uint64(33 * lane)) & _PRIME if values.dtype == np.uint64 else part.astype(np.uint64) + np.uint64(1)
                own *= power[k : k + len(own)]
                np.cumsum(_fold(own), out=sums[k + 1 : k + 1 + len(own)])
                sums[k + 1 : k + 1 + len(own)] += sums[k]
            self.lanes.append((sums, inverse))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        for sums, inverse in self.lanes:
            part = _fold(_fold(_fold(_fold(sums[ends] - sums[starts])) * inverse[starts]))
            part = np.where(part >= _PRIME, part - _PRIME, part)
            out = (out << _BITS) | part
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    return SpanHasher(values, seed)(starts, ends)


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of every ``width`` consecutive values; windows may cross texts, callers mask those."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(count)
    return span_hashes(words, starts, starts + width, seed)


def same_text(first_word: np.ndarray, count: int, width: int) -> np.ndarray:
    """Whether the window of ``width`` words at each of ``count`` positions lies within one text."""
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    return text[:count] == text[width - 1 : width - 1 + count]
