"""Exact, line, substring and SimHash deduplication against brute force on small tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import exact_dedup as ed
from loomwork.llm import line_dedup, simhash, substring_dedup
from loomwork.llm.components import connected

SCHEMA = "doc_id long, text string, kept string, row int, _key int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA)


def squeeze(t):
    return "".join((t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)}))


ODD = [(None, "only null id"), (None, ""), (7, None), (8, ""), (9, " \n\t"), (1, "a b"), (1, "a b"), (2, "ab"), (3, "a  b "), (4, "é x"), (5, "é x"), (6, "\U0001f600" * 3), (10, "z" * 5000), (11, "z" * 5000)]


@pytest.mark.parametrize("bucket", [ed.BUCKET_BYTES, 200])
def test_exact_groups(spark, bucket):
    rng = random.Random(3)
    rows = ODD + [(100 + n, rng.choice(["aa bb", "cc", "dd ee ff", "g" * 40]) + " " * rng.randint(0, 3)) for n in range(300)]
    got = ed.exact_dedup(table(spark, rows), bucket_bytes=bucket).collect()
    groups = {}
    for k, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), k is None, k or 0, k))
    assert len(got) == len(rows)
    for r in got:
        own = groups[squeeze(r["text"])]
        best = min(own)
        assert (r["group_size"], r["keep_id"]) == (len(own), best[3])
        assert r["kept"] == (r["doc_id"] == best[3] and len(r["text"] or "") == -best[0])
        assert r["text_sha256"] == hashlib.sha256(squeeze(r["text"]).encode()).hexdigest()


def test_table_compares_contents_under_equal_hashes():
    contents = [b"a", b"b", b"a", b"c", b"b"]
    owner = ed.distinct_slots(np.zeros(5, dtype=np.int64), contents)
    assert [contents[k] for k in owner] == contents and len(set(owner.tolist())) == 3


def test_grace_recurses(tmp_path):
    rows = [(i % 500) for i in range(2000)]
    batch = pa.table([pa.array([xxhash.xxh64_intdigest(str(r)) - 2**63 for r in rows], pa.int64()), pa.array([str(r).encode() * 20 for r in rows], pa.large_binary()), pa.array([1] * 2000, pa.int64()), pa.array([1] * 2000, pa.int64()), pa.array(range(2000), pa.int64()), pa.array([True] * 2000)], schema=ed._SCHEMA)
    found = pa.concat_tables(ed.grace(iter([batch.slice(k, 100) for k in range(0, 2000, 100)]), bucket_bytes=3000))
    assert found.num_rows == 500 and set(found["rows"].to_pylist()) == {4} and max(found["best_id"].to_pylist()) == 499


def test_line_dedup(spark):
    a = "l1\nl2\nl3\nl4"
    rows = [(2, "x\nl1\nl2\nl3\ny"), (1, a), (3, a), (4, "l1\nl2"), (5, None), (6, ""), (7, "q\nq\nq\nq\nq"), (None, "z\nz2\nz3"), (8, "z\nz2\nz3")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert (got[2]["text"], got[2]["n_removed"], got[1]["text"], got[3]["text"], got[3]["n_lines"]) == ("x\ny", 3, a, "", 4)
    assert got[5]["text"] is None and got[5]["n_lines"] == 0 and got[6]["text"] == "" and got[4]["text"] == "l1\nl2"
    assert got[7]["text"] == "q" and got[None]["n_removed"] == 0 and got[8]["text"] == ""


def brute_substrings(rows, window):
    docs = sorted(((k is not None, k or 0, (t or "")) for k, t in rows))
    seen, out = {}, {}
    order = [(i, d, t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")) for i, (_, d, t) in enumerate(docs)]
    order = [(i, d, [w for w in ws if w]) for i, d, ws in order]
    for i, _, ws in order:
        for p in range(len(ws) - window + 1):
            seen.setdefault(tuple(ws[p : p + window]), (i, p))
    for (nonnull, d, _), (i, _, ws) in zip(docs, order, strict=True):
        gone = set()
        for p in range(len(ws) - window + 1):
            if seen[tuple(ws[p : p + window])] < (i, p):
                gone |= set(range(p, p + window))
        out[d if nonnull else None] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize(("window", "shortest", "hot"), [(20, 10, 5_000), (20, 10, 2), (20, 5, 3), (6, 10, 3)])
def test_substrings(spark, monkeypatch, window, shortest, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SALTS", 4)
    rng = random.Random(window)
    passages = [[f"p{n}w{k}" for k in range(rng.randint(15, 60))] for n in range(6)]
    rows = [(None, " ".join(passages[0])), (500, None), (501, ""), (502, "a " * 200), (503, "one")]
    for n in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 30))]
        rows.append((n, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(900 + n, rows[10][1]) for n in range(3)]
    got = substring_dedup.substring_dedup(table(spark, rows), window=window, shortest=shortest).collect()
    want = brute_substrings(rows, window)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]], r["doc_id"]


def test_substrings_of_repeated_ids(spark):
    p = " ".join(f"w{k}" for k in range(30))
    got = substring_dedup.substring_dedup(table(spark, [(1, p), (1, p), (2, p), (2, "new " + p)])).orderBy("doc_id", "text").collect()
    assert [r["n_removed"] for r in got] == [0, 0, 30, 30]


def brute_simhash(rows, width):
    out = []
    for _, t in rows:
        ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        sh = [" ".join(ws[k : k + width]) for k in range(len(ws) - width + 1)] if len(ws) >= width else ([" ".join(ws)] if ws else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklm") + rng.choice("nopqrstuv") for _ in range(400)] for _ in range(12)]
    rows = [(None, ""), (70, None), (71, "One"), (72, "one"), (73, "É x"), (74, "é x")]
    for n in range(50):
        words = list(base[n % 12])
        for _ in range(n // 12):
            words[rng.randrange(400)] = "zz"
        rows.append((n, " ".join(words)))
    rows += [(80, rows[10][1]), (81, rows[10][1])]
    prints = brute_simhash(rows, 4)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    want = {}
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        want[k] = (f"{prints[i]:016x}", None if None in ids else min(ids))
    got = simhash.simhash_components(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    kept = {r["doc_id"] for r in simhash.near_duplicates(table(spark, rows)).where("kept").collect()}
    assert kept == {k for k, (_, c) in want.items() if k == c} and "kept" in simhash.near_duplicates(table(spark, rows)).columns


def test_every_pair_within_four_bits_meets():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        for segments in (simhash.SEGMENTS, simhash.LONG_SEGMENTS):
            met = []
            for first, bits, radius in segments:
                x, y = (v >> first & ((1 << bits) - 1) for v in (a, b))
                met.append((x ^ y).bit_count() <= radius)
            assert any(met)


@pytest.mark.parametrize("segments", [simhash.SEGMENTS, simhash.LONG_SEGMENTS])
def test_close_fingerprints_share_a_bucket(segments):
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))))
    nodes = np.array(pairs, dtype=np.uint64).ravel()
    (got,) = simhash._posts(segments)(iter([pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64))], names=["node"])]))
    held = {}
    for bucket, node in zip(got["bucket"].to_pylist(), got["node"].to_numpy().view(np.uint64).tolist(), strict=True):
        held.setdefault(node, set()).add(bucket)
    assert all(held[a] & held[b] for a, b in pairs)


def test_hot_buckets_are_cut_into_blocks(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(7) for _ in range(90)]
    posts = spark.createDataFrame([(1, v) for v in values] + [(2, 1000)], "bucket long, node long")
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for block in (1000, 10, 3):
        for v in values:
            parent[v] = v
        for r in simhash.bucket_links(posts, ["node"], 1, block).collect():
            parent[find(r["a"])] = find(r["b"])
        got = {v: find(v) for v in values}
        for v in values:
            parent[v] = v
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 1:
                    parent[find(a)] = find(b)
        assert len({(got[v], find(v)) for v in values}) == len(set(got.values())) == len({find(v) for v in values})


def test_large_buckets_lose_no_link():
    values = np.array(sorted({random.Random(k).getrandbits(6) for k in range(200)}), dtype=np.uint64)
    links = values[simhash._forest(values[:, None], 1)].tolist()
    assert len(simhash._links_of_bucket(values[:, None], 1)) >= len(links)
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    for a in values.tolist():
        for b in values.tolist():
            if (a ^ b).bit_count() <= 1:
                assert find(a) == find(b)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(1000, 1100)} == {1000}


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    for made in (ed.exact_dedup(none), line_dedup.line_dedup(none), substring_dedup.substring_dedup(none), simhash.simhash_components(none), simhash.near_duplicates(none)):
        assert made.count() == 0


def test_digests_have_the_contract_columns(spark):
    docs = table(spark, [(1, "a b c")]).select("doc_id", "text", F.lit("en").alias("lang"))
    assert ed.exact_dedup_digest(docs).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert substring_dedup.substring_dedup_digest(docs).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_groups_of_a_hot_window_follow_its_count(spark, monkeypatch):
    """A passage in 3,000 documents, dealt by its measured count: the first keeps it, all others lose it, their own words stay."""
    monkeypatch.setattr(substring_dedup, "HOT", 50)
    monkeypatch.setattr(substring_dedup, "SALTS", 2)
    passage = " ".join(f"p{k}" for k in range(25))
    rows = spark.range(3_000, numPartitions=6).selectExpr("id doc_id", f"concat('a', id, ' {passage} z', id) text")
    got = substring_dedup.substring_dedup(rows)
    assert got.where("n_removed = 25 and kept_text = concat('a', doc_id, ' z', doc_id)").count() == 2_999
    assert got.where("n_removed = 0").select("doc_id").collect() == [(0,)]
    assert substring_dedup.levels(6, 10) == [6] and substring_dedup.levels(20, 5) == [5, 10] and substring_dedup.levels(40, 10) == [10, 20]
