"""Near copies by Jaccard similarity, and the pipeline's stage, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import components, simhash
from loomwork.llm import near_copies as nc
from loomwork.llm.simhash import LONG_SEGMENTS, MANY, _verify, bucket_links, fingerprint_links


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(rows, similarity=0.8):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    linked = [[j for j in range(len(rows)) if jaccard(sets[i], sets[j]) >= similarity] for i in range(len(rows))]
    for _ in rows:
        for i in range(len(rows)):
            group[i] = min(group[j] for j in linked[i])
    ids = lambda g: [(k is not None, k or 0) for (k, _), x in zip(rows, group, strict=True) if x == g]
    return {k for (k, _), g in zip(rows, group, strict=True) if (k is not None, k or 0) == min(ids(g))}


def sample():
    rng = random.Random(11)
    rows = [(None, "only a null id has this"), (900, None), (901, " \n"), (902, "One two"), (903, "one  TWO"), (904, "one three")]
    for n in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(60, 400))]
        for k in range(6):
            words = list(base)
            for _ in range(k * len(base) // 120):  # from the same text to about half of the shingles
                words[rng.randrange(len(words))] = f"z{rng.randrange(10_000)}"
            rows.append((n * 10 + k, " ".join(words)))
    return rows


def test_stage_drops_copies_with_scattered_edits(spark):
    rows = sample()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.simhash(spark, docs, "").collect()}
    assert got == kept_by_brute_force(rows)


def test_stage_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"]).where("text is not null")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"] for r in corpus_pipeline.simhash(spark, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars"), "").collect()}
    assert got == kept_by_brute_force(rows)


def test_repeated_rows_and_empty_tables(spark):
    t = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (2, t, "x"), (3, "other words", "x")], "doc_id long, text string, kept string")
    got = nc.near_copies(rows)
    assert sorted((r["doc_id"], r["kept"]) for r in got.collect()) == [(1, True), (1, True), (2, False), (3, True)] and got.columns == ["doc_id", "text", "kept"]
    assert nc.near_copies(rows.limit(0)).count() == 0


def test_groups_follow_exact_links():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 10, 20, 60)]  # neighbours at 90/110, 80/120 between the ends
    assert nc.roots_of_group(np.array([4, 9, 7, 5]), sets, 0.8).tolist() == [4, 4, 4, 5]


def test_groups_with_more_texts_than_hubs(spark, monkeypatch):
    """A chain of texts whose neighbours alone are alike, and a crowd around one text, beside small groups; blocks of a few texts."""
    monkeypatch.setattr(nc, "CELL_TEXTS", 7)
    monkeypatch.setattr(nc, "HUBS", 3)
    rng = np.random.default_rng(3)
    texts = [np.arange(10 * k, 10 * k + 100, dtype=np.uint64) for k in range(60)]
    crowd = rng.integers(0, 2**63, 100, dtype=np.uint64)
    for _ in range(60):
        own = crowd.copy()
        own[rng.choice(100, rng.integers(0, 9), replace=False)] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        texts.append(np.unique(own))
    groups = [0] * 60 + [1] * 60
    texts += [texts[0] + np.uint64(10**6), texts[0] + np.uint64(10**6 + 5), texts[0] + np.uint64(2 * 10**6), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    groups += [2, 2, 3, 4, 4]
    ids = rng.permutation(len(texts)).tolist()
    rows = [(g, k, bytearray(np.sort(t).tobytes())) for g, k, t in zip(groups, ids, texts, strict=True)]
    got = {r["node"]: r["root"] for r in nc.exact_roots(spark.createDataFrame(rows, "component long, node long, hashes binary")).collect()}
    for g in set(groups):
        own = [(k, np.sort(t)) for h, k, t in zip(groups, ids, texts, strict=True) if h == g]
        want = nc.roots_of_group(np.array([k for k, _ in own]), [t for _, t in own], 0.8)
        assert [got.get(k, k) for k, _ in own] == want.tolist()


def test_crowds_that_only_some_hubs_know(spark, monkeypatch):
    """No text is left over: each is linked to a hub, some to two hubs that are not linked themselves."""
    monkeypatch.setattr(nc, "HUBS", 3)
    base = np.arange(100, dtype=np.uint64)
    # texts at 0, 10 and 20 of a line: neighbours are alike (90/110), the ends are not (80/120)
    shift = {1: 0, 2: 20, 3: 500, 4: 10, 5: 0, 6: 500, 7: 505, 8: 20}
    rows = [(0, k, bytearray((base + np.uint64(s)).tobytes())) for k, s in shift.items()]
    rows += [(10, k, bytearray((base + np.uint64(s)).tobytes())) for k, s in {10: 0, 11: 40, 12: 80, 13: 0, 14: 42}.items()]
    got = {r["node"]: r["root"] for r in nc.exact_roots(spark.createDataFrame(rows, "component long, node long, hashes binary")).collect()}
    assert {k: got.get(k, k) for k in (*shift, *range(10, 15))} == {1: 1, 2: 1, 4: 1, 5: 1, 8: 1, 3: 3, 6: 3, 7: 3, 10: 10, 13: 10, 11: 11, 14: 11, 12: 12}


def test_parts_of_different_hubs_are_linked_by_their_other_texts(spark, monkeypatch):
    """Each text is linked to a hub, and two texts of hubs that are far apart to each other: one group; a text that is linked to no hub may join parts, too."""
    monkeypatch.setattr(nc, "HUBS", 2)
    base = np.arange(100, dtype=np.uint64)
    # neighbours at 10 of a line are alike (90/110), those at 20 are not (80/120)
    shift = {1: 0, 2: 30, 3: 10, 4: 20, 10: 0, 11: 40, 12: 10, 13: 30, 14: 20, 15: 10, 20: 0, 21: 60, 22: 10, 23: 50}
    rows = [(k // 10, k, bytearray((base + np.uint64(s)).tobytes())) for k, s in shift.items()]
    got = {r["node"]: r["root"] for r in nc.exact_roots(spark.createDataFrame(rows, "component long, node long, hashes binary")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, **dict.fromkeys(range(10, 16), 10), 20: 20, 22: 20, 21: 21, 23: 21}
    assert {k: got.get(k, k) for k in shift} == want


def test_links_of_a_hot_cluster_are_contracted(spark):
    """Copies that meet in dozens of buckets leave hardly more than a link each, which connect the same nodes."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (2, 47 * 12))
    rows = []
    for node in range(3000):
        bits = base[node % 2] ^ (rng.random(47 * 12) < 0.15)
        value = bits.reshape(47, 12) @ (1 << np.arange(12))
        rows.append((node * 7919 % 100_003, [int(v) + 4096 * s for s, v in enumerate(value)], node % 2))
    posts = spark.createDataFrame(rows, "node long, keys array<long>, half long").select("node", F.col("half").alias("c0"), F.lit(0).cast("long").alias("c1"), F.explode("keys").alias("bucket"))
    links = bucket_links(posts, ["c0", "c1"], 0)
    assert links.count() < 3 * len(rows)
    cells = posts.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "c0", "c1").repartition("bucket").sortWithinPartitions("bucket", "node")
    plain = cells.mapInArrow(_verify(["c0", "c1"], 0), "a long, b long").where("a != b")
    assert plain.count() > 20 * len(rows)
    found = {r["node"]: r["component"] for r in components.connected(links).collect()}
    want = {r["node"]: r["component"] for r in components.connected(plain).collect()}
    assert found == want and len(set(found.values())) == 2


def test_contraction_keeps_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    links = spark.createDataFrame([(max(p), min(p)) for p in pairs if p[0] != p[1]], "a long, b long")
    want = {(r["node"], r["component"]) for r in components.connected(links).collect()}
    assert {(r["node"], r["component"]) for r in components.connected(components.contracted(links)).collect()} == want


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    """With a hash that tells nothing, texts are told by their digests."""
    monkeypatch.setattr(nc, "_hash", lambda text: F.lit(7).cast("long"))
    rows = [(k, f"text number {k} has words of its own {k * 37}") for k in range(30)] + [(50, None), (51, ""), (52, "text number 3 has words of its own 111")]
    got = {r["doc_id"]: r["kept"] for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, kept in got.items() if not kept} == {51, 52}


def test_hot_buckets_are_posted_again_by_pieces(spark):
    """Fingerprints that agree in whole segments: each bucket is far larger than a block, and no link is lost."""
    rng = np.random.default_rng(4)
    for many, fixed in ((False, (0, 21)), (False, (42, 64)), (True, (0, 32)), (True, (32, 64))):
        mask = np.uint64((1 << fixed[1]) - (1 << fixed[0]))
        base = (rng.integers(0, 2**64, 60, dtype=np.uint64) & ~mask) | np.uint64(0x5555555555555555) & mask
        prints = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(4)])).view(np.int64)
        df = spark.createDataFrame([(int(x),) for x in prints], "fp long")
        links = fingerprint_links(df, MANY + 1 if many else 10, block=20)
        found = {r["node"]: r["component"] for r in components.connected(links).collect()}
        near = np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)[None]) <= 4
        want = {}
        for k in range(len(prints)):
            reach, todo = {k}, [k]
            while todo:
                more = set(np.flatnonzero(near[todo.pop()]).tolist()) - reach
                reach |= more
                todo += more
            want[int(prints[k])] = min(int(prints[j]) for j in reach)
        assert {k: found.get(k, k) for k in want} == want and len(LONG_SEGMENTS) == 2

def test_probes_reach_what_shares_no_segment(spark):
    """A pair with a bit of each segment flipped agrees in none, and is found; one that agrees in a segment, but is too far apart as a whole, is not."""
    form, rng = nc.shape(200_000), np.random.default_rng(8)
    size = form.segments * form.bits
    base = rng.integers(0, 2, (4, size)).astype(bool)
    flip = np.zeros(size, dtype=bool)
    flip[np.arange(form.segments) * form.bits + rng.integers(0, form.bits, form.segments)] = True
    far = np.zeros(size, dtype=bool)
    far[form.bits : form.bits + form.distance + 1] = True
    rows = [*base, base[0] ^ flip, base[1] ^ far, base[2] ^ np.roll(far, -1) & far, base[3] ^ flip]
    words = np.packbits(np.pad(np.array(rows), ((0, 0), (0, -size % 64))), axis=1, bitorder="little").view("<i8")
    prints = spark.createDataFrame([(k, False, *map(int, w)) for k, w in enumerate(words)], f"node long, few boolean, {', '.join(f'{c} long' for c in form.words)}")
    assert {(r["a"], r["b"]) for r in nc.fingerprint_links(prints, form).collect()} == {(4, 0), (6, 2), (7, 3)}
    assert form.distance >= 2 * form.segments - 1


def test_fingerprint_bits_are_majorities():
    sets = [np.array([], dtype=np.uint64), np.array([5], dtype=np.uint64), np.arange(40_000, dtype=np.uint64)]
    got = nc.fingerprints(sets, 2)
    for own, words in zip(sets, got, strict=True):
        for k in range(128):
            ones = sum(int(h) >> k % 64 & 1 for h in nc.mix(own + np.uint64(k // 64)))
            assert int(words[k // 64]) >> k % 64 & 1 == (2 * ones > len(own))


def test_pairs_at_the_similarity_are_linked_at_every_size(spark):
    """Pairs of a similarity of 0.8 or hardly more, by the sizes whose fingerprints differ most: 400 of each, of which at most two are missed."""
    rows, form = [], nc.shape(200_000)
    for n, (a, b, shared) in enumerate(((4, 5, 4), (12, 15, 12), (21, 24, 20), (100, 100, 89))):
        for k in range(400):
            own = np.random.default_rng(1000 * n + k).integers(0, 2**63, a + b - shared, dtype=np.uint64)
            rows += [np.sort(own[:a]), np.sort(own[a - shared :])]
    words = nc.fingerprints(rows, len(form.words)).view(np.int64)
    prints = spark.createDataFrame([(k, len(rows[k]) <= nc.FEW, *map(int, w)) for k, w in enumerate(words)], f"node long, few boolean, {', '.join(f'{c} long' for c in form.words)}")
    found = {r["node"]: r["component"] for r in components.connected(nc.fingerprint_links(prints, form)).collect()}
    missed = [k // 400 for k in range(1600) if 2 * k not in found or found[2 * k] != found.get(2 * k + 1)]
    assert all(missed.count(n) <= 2 for n in range(4))


def test_probes_of_a_hot_group_make_no_links_again(spark, monkeypatch):
    """Near copies, also some of few shingles, meet in the buckets that they probe, too: rows made are a few for each segment, in blocks as well, and connect the same."""
    monkeypatch.setattr(simhash, "contracted", lambda links: links)
    form, rng = nc.shape(200_000), np.random.default_rng(9)
    size, width = form.segments * form.bits, 64 * len(form.words)
    columns = [*form.words, "kind"]
    for n, block in ((300, 16_384), (400, 150)):
        monkeypatch.setattr(nc, "BLOCK", block)
        bits = rng.integers(0, 2, (3, width)).astype(bool)[rng.integers(0, 3, n)] ^ (rng.random((n, width)) < rng.choice([0.03, 0.13], n)[:, None])
        bits[:, size:] = False
        rows = [(int(k), bool(k % 5 == 0), *map(int, w)) for k, w in zip(rng.permutation(n), np.packbits(bits, axis=1, bitorder="little").view("<i8"), strict=True)]
        prints = spark.createDataFrame(rows, f"node long, few boolean, {', '.join(f'{c} long' for c in form.words)}")
        links = nc.fingerprint_links(prints, form).localCheckpoint()
        posts = prints.mapInArrow(nc._posts(form), f"bucket long, node long, {', '.join(f'{c} long' for c in columns)}")
        plain = simhash.bucket_links(posts, columns, form.distance, within=nc._pairs(form.few)).localCheckpoint()
        assert links.count() < 40 * n and plain.count() > 80 * n
        found, want = ({r["node"]: r["component"] for r in components.connected(x).collect()} for x in (links, plain))
        assert found == want and len(want) > 0.9 * n


def test_balls_are_shuffled_by_zones(spark, monkeypatch):
    """Little more than half of the posts' rows are shuffled, give all posts, each bucket's in one partition, and connect what posts do; large buckets, too."""
    monkeypatch.setattr(simhash, "contracted", lambda links: links)
    form, rng = nc.shape(200_000), np.random.default_rng(12)
    bits = rng.integers(0, 2, (150, 64 * len(form.words))).astype(bool)[np.arange(600) % 150] ^ (rng.random((600, 64 * len(form.words))) < 0.06)
    value = bits[:, : form.segments * form.bits].reshape(600, form.segments, form.bits) @ (1 << np.arange(form.bits))
    rows = [(k, k % 7 == 0, *map(int, w)) for k, w in enumerate(np.packbits(bits, axis=1, bitorder="little").view("<i8"))]
    columns = ", ".join(f"{c} long" for c in form.words)
    prints = spark.createDataFrame(rows, f"node long, few boolean, {columns}")
    posts = prints.mapInArrow(nc._posts(form), f"bucket long, node long, {columns}, kind long")
    zones = prints.mapInArrow(nc._zones(form), f"zone long, value long, node long, few boolean, {columns}").repartition(9, "zone")
    dealt = nc._of_zones(zones, form).withColumn("part", F.spark_partition_id()).localCheckpoint()
    want = set()
    for k in range(600):
        for s, v in enumerate(value[k].tolist()):
            for flips in nc._masks(form.bits, 2 if k % 7 == 0 else 1).tolist():
                if not v & flips:
                    want.add(((s << form.bits) + (v | flips), k, 2 * flips + (k % 7 == 0)))
    got = [(r["bucket"], r["node"], r["kind"]) for r in dealt.collect()]
    assert len(got) == len(want) and set(got) == want and {(r["bucket"], r["node"], r["kind"]) for r in posts.collect()} == want
    assert zones.count() < 0.6 * len(got)
    assert dealt.groupBy("bucket").agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()
    for block in (16_384, 12):
        plain = simhash.bucket_links(posts, [*form.words, "kind"], form.distance, block, within=nc._pairs(form.few))
        monkeypatch.setattr(nc, "BLOCK", block)
        found, all_found = ({r["node"]: r["component"] for r in components.connected(x).collect()} for x in (nc.fingerprint_links(prints, form), plain))
        assert found == all_found and len(found) > 500


def test_few_links_make_few_files(spark):
    """The rounds of the components hand on a partition for so many links, not one for each shuffle partition, and find the same."""
    rng = random.Random(4)
    links = spark.createDataFrame([(rng.randrange(900), rng.randrange(900)) for _ in range(600)], "a long, b long")
    want = {(r["node"], r["component"]) for r in components.connected(links).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few = components.connected(links, rows=200)
        assert few.rdd.getNumPartitions() <= 3 + 4 and {(r["node"], r["component"]) for r in few.collect()} == want
        assert components.connected(links).rdd.getNumPartitions() > few.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
