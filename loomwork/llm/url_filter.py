"""URL filters: a blocked Bloom filter of the listed canonical keys in front of an exact hash join.

Everything is DataFrame work. A page's candidate keys are its host's last labels (as many as any rule has) combined with
the prefixes of its path at the lengths that the rules use. The Bloom filter is a table of 256-bit blocks (four longs): a
key sets one bit in each of the four words of one block, so that a probe is one row of a join by the block's number. The
table has a bounded number of rows and is broadcast. Only the keys that pass are joined with the rules, which removes the
false positives; the best rule of each page is then joined back to it, and nothing else of a page is shuffled but its id
and URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rule list is broadcast up to this many rows (some 100 bytes each); a longer one is shuffled to the keys.
BROADCAST_RULES = 200_000
#: Blocks of the Bloom filter at most, 40 bytes each and so some 10 MB; beyond eight million rules only the share of false positives rises.
MAX_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 8


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _block(key_hash: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key_hash, 32), F.lit(blocks)).cast("int")


def _bit(key_hash: Column, word: int) -> Column:
    """The bit of this word: six bits of the hash choose it."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key_hash, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """``block, w0, w1, w2, w3``: a row for each block in which a key sets bits."""
    h = F.xxhash64(F.col(column))
    set_bits = keys.select(_block(h, blocks).alias("block"), *(_bit(h, w).alias(f"w{w}") for w in range(4)))
    return set_bits.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4)))


def may_contain(rows: DataFrame, column: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key in ``column`` the filter may contain; ``bloom`` has ``blocks`` rows at most and is broadcast."""
    h = F.xxhash64(F.col(column))
    joined = rows.withColumn("block", _block(h, blocks)).join(F.broadcast(bloom), "block")
    for w in range(4):
        joined = joined.where(F.col(f"w{w}").bitwiseAND(_bit(h, w)) == _bit(h, w))
    return joined.select(*rows.columns)


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every ``suffix of host + prefix of path`` that a rule could be; suffixes are of 1 to ``labels`` whole labels, or the host."""
    parts = F.slice(F.reverse(F.split(host, r"\.")), 1, labels)
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.reverse(F.slice(parts, 1, n)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    return F.flatten(F.transform(upto, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\u0000"), p))))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, ``host``, ``path``, the longest rule that fits and its verdict.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and every subdomain if the path starts with
    the rule's; the longest ``host + path`` wins, then the longer host. A page that no rule fits is not listed: its
    ``rule`` is null and its ``verdict`` is ``default``. Null URLs and URLs without ``://`` have empty host and path.
    Rows stay as often as they occur, null ids too; an empty table gives an empty result; other columns are ignored. A
    rule that is listed twice counts once (of two verdicts, the first in order). URLs may be of any length: the work is in
    proportion to it, and to the labels and path lengths of the rules.
    """
    rules = rules.select(
        F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER).alias("rule_host"),
        F.coalesce(F.col("path"), F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    )
    rules = rules.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    rules = rules.withColumn("rule_key", F.concat("rule_host", F.lit("\u0000"), "rule_path"))
    facts = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    blocks = max(1, min(MAX_BLOCKS, facts["n"] // KEYS_PER_BLOCK + 1))
    listed = F.broadcast(rules) if facts["n"] <= BROADCAST_RULES else rules

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    keys = candidate_keys(url_host(F.col("url")), url_path(F.col("url")), facts["labels"] or 1, sorted(facts["lengths"]) or [0])
    probes = rows.select("id", "url", F.explode(keys).alias("rule_key"))
    hits = may_contain(probes, "rule_key", bloom_blocks(rules, "rule_key", blocks), blocks).join(listed, "rule_key")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    # grouped under another key than the join's, so that Spark can split a page that is repeated very often
    best = hits.groupBy(F.struct("id", "url").alias("page")).agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))
    best = best.select(F.col("page.id").alias("best_id"), F.col("page.url").alias("best_url"), "best")
    joined = rows.join(best, F.col("id").eqNullSafe(F.col("best_id")) & F.col("url").eqNullSafe(F.col("best_url")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
