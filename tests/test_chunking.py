"""Folds against naive loops, and structure on hand-made files."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import chunking, packing_folds, structure, validation


def naive(tokens, target, overlap, least):
    """The windows by their definition: sums over slices for every place."""
    out, start, n = [], 0, len(tokens)
    while start < n:
        stop = next(e for e in range(start + 1, n + 1) if e == n or (sum(tokens[start : e + 1]) > target and sum(tokens[start:e]) >= least))
        out.append((start, stop))
        carried = next((b for b in range(start, stop) if sum(tokens[b:stop]) <= overlap), stop - 1) if overlap else stop
        start = n if stop == n else carried if carried > start else max(start + 1, stop - 1)
    return out


@pytest.mark.parametrize(("target", "overlap", "least"), [(350, 0, 120), (300, 0, 120), (900, 180, 300), (50, 60, 20)])
def test_folds_match_the_loop(spark, target, overlap, least):
    rng = random.Random(target + overlap)
    lists = [[rng.choice((1, 5, 30, 100, 250, 400, 950)) for _ in range(rng.randint(0, 30))] for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(lists)), "n int, tokens array<int>")
    column = packing_folds.pack_with_overlap(F.col("tokens"), target, overlap, least) if overlap else packing_folds.pack_without_overlap(F.col("tokens"), target, least)
    for r in df.select("tokens", column.alias("r")).collect():
        assert [tuple(x) for x in r["r"]] == naive(r["tokens"], target, overlap, least), r["tokens"]


@pytest.mark.parametrize(("tokens", "target", "overlap", "least", "starts"), [([300, 100, 100], 350, 0, 120, [0, 1]), ([100, 400, 50], 350, 0, 120, [0, 2]), ([500, 250, 100, 200], 900, 180, 300, [0, 2]), ([500, 300, 150, 200], 900, 180, 300, [0, 1])])
def test_known_windows(tokens, target, overlap, least, starts):
    assert [a for a, _ in naive(tokens, target, overlap, least)] == starts
    if overlap:
        assert [a for a, _ in packing_folds.overlapping_ranges(tokens, target, overlap, least)] == starts


def files(spark, *texts):
    rows = [("book", "Book", f"book_ch{n + 1}_intro-part.words.txt", n, t) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, doc_title string, source_file string, source_file_index int, text string")


BODY = " ".join(f"word{k}" for k in range(25))


def test_header_attaches_to_a_long_block(spark):
    f = files(spark, f"The First Part\n\n{BODY}\n\nshort end", BODY)
    got = structure.build_paragraphs(f).orderBy("paragraph_id").collect()
    assert [(r["paragraph_type"], r["source_block_start"], r["source_block_end"]) for r in got] == [("headed_body", 0, 1), ("body", 2, 2), ("body", 0, 0)]
    assert got[0]["text"] == f"The First Part\n\n{BODY}" and got[0]["header_text"] == "The First Part"
    assert [r["char_start_in_doc"] for r in got] == [0, len(got[0]["text"]) + 2, len(got[0]["text"]) + len("short end") + 4]
    assert (got[0]["section_path"], got[0]["chapter_label"], got[0]["node_id"]) == (["CH1", "Intro Part"], "CH1", "book::book_ch1_intro-part::node")
    nodes = structure.build_nodes(f, structure.build_paragraphs(f)).orderBy("source_file_index").collect()
    assert [r["paragraph_ids"] for r in nodes] == [[0, 1], [2]]


def test_names_with_and_without_tokens(spark):
    rows = [("b", "b.words.txt"), ("b", "b_intro_more-x.words.txt"), ("b", "b_sec2a_ch1_pt3_my_label.words.txt"), ("b", "other.words.txt")]
    df = spark.createDataFrame(rows, "doc_id string, source_file string")
    got = {r["source_file"]: r["section_path"] for r in structure.structure_from_name(df).collect()}
    assert got == {"b.words.txt": ["b"], "b_intro_more-x.words.txt": ["Intro", "More X"], "b_sec2a_ch1_pt3_my_label.words.txt": ["CH1", "SEC2A", "PT3", "My Label"], "other.words.txt": ["Other"]}


def test_long_blocks_are_split(spark):
    block = " ".join(f"{' '.join(f'w{k}' for k in range(30))} end{n}." for n in range(14))
    got = spark.createDataFrame([(block,)], "t string").select(structure.expand_blocks(F.array("t"))).first()[0]
    assert " ".join(got) == block and all(len(p.split()) <= 300 for p in got) and len(got) > 1


def test_chunks_of_a_book(spark):
    sentence = " ".join(f"w{k}" for k in range(24)) + " x."
    f = files(spark, "\n\n".join(sentence.replace("w1 ", f"a{n} ") for n in range(30)), " ".join([sentence] * 40), " ")
    units = chunking.build_units(structure.build_paragraphs(f))
    chunks = chunking.chunk_corpus(units).persist()
    validation.validate_chunks(chunks)
    rows = {k: [r for r in chunks.orderBy("chunk_index").collect() if r["retrieval_setting"] == k] for k in ("small_fixed", "medium_overlap", "hierarchical_parent", "hierarchical_child")}
    assert len(rows["hierarchical_parent"]) == 2  # the empty file has no node with units
    small = rows["small_fixed"]
    assert [r["prev_chunk_id"] for r in small] == [None, *(r["chunk_id"] for r in small[:-1])] and small[-1]["next_chunk_id"] is None
    medium = rows["medium_overlap"]
    assert medium[0]["overlap_with_prev_tokens"] == 0 and medium[0]["overlap_with_next_tokens"] == medium[1]["overlap_with_prev_tokens"] > 0
    kids = {p["chunk_id"]: p["children_ids"] for p in rows["hierarchical_parent"]}
    for parent, ids in kids.items():
        own = [c for c in rows["hierarchical_child"] if c["parent_id"] == parent]
        assert [c["chunk_id"] for c in own] == ids and own[0]["prev_chunk_id"] is None and own[-1]["next_chunk_id"] is None
    for u in units.collect():
        assert u["char_end_in_doc"] - u["char_start_in_doc"] >= len(u["text"])


def test_checks_find_what_is_wrong(spark):
    bad = spark.createDataFrame([("a", None), ("a", "p")], "chunk_id string, parent_id string")
    assert validation.duplicate_ids(bad).count() == 1 and validation.orphans(bad.where("parent_id is not null"), bad).count() == 1
    with pytest.raises(ValueError):
        validation.require_none(bad, "bad")
    vectors = spark.createDataFrame([(0, "x", [1.0]), (2, "x", [1.0]), (3, "x", [1.0, 2.0])], "embedding_row int, embedding_partition string, embedding array<double>")
    assert validation.gaps_in_rows(vectors).count() == 2 and validation.wrong_sizes(vectors).count() == 1


def test_quality_report_and_natural_order(spark):
    p = spark.createDataFrame([("d", 0, 900), ("d", 1, 310), ("d", 2, 5)], "doc_id string, paragraph_id int, word_count int")
    r = structure.quality_report(p).first()
    assert (r["paragraphs"], r["max_words"], r["over_300_words"], r["over_800_words"], r["largest"]) == (3, 900, 2, 1, [900, 310, 5])
    names = spark.createDataFrame([("ch10",), ("ch2",), ("Ch1",)], "n string")
    assert [r["n"] for r in names.orderBy(structure.natural_order(F.col("n"))).collect()] == ["Ch1", "ch2", "ch10"]
