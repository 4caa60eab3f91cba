"""Windows, prompts, runs, scores and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import prompts, reports, scoring, windows
from loomwork.plans import corpus, experiment
from loomwork.sources import pdf, readers, sinks
from loomwork.streaming import scores as streaming


def vignette_file(path, turn_range=(2, 3)):
    turns = [{"turn_id": k, "speaker": s, "utterance": u} for k, s, u in ((1, "A", "one"), (2, "B", " two "), (3, None, "three"), (4, "A", ""))]
    data = {"vignettes": [{"vignette_id": "V001", "title": "t", "likely_parts": ["x"], "transcript": turns, "consultation_windows": [{"window_id": "W1", "turn_range": list(turn_range), "target_ifs_goal": "g", "expected_retrieval_theme": "e"}]}]}
    path.write_text(json.dumps(data))
    return str(path)


def test_windows(spark, tmp_path):
    v = readers.vignettes(spark, vignette_file(tmp_path / "v.json"))
    r = windows.window_texts(v).first()
    assert (r["query"], r["slug"], r["turn_range"]) == ("B: two\nUnknown: three", "v001__w1", [2, 3])
    assert windows.one(v, vignette_id="V001").count() == 1
    with pytest.raises(ValueError):
        windows.one(v, vignette_id="V9")
    for bad in ((3, 2), (4, 4), (9, 9)):
        with pytest.raises(Exception):
            windows.window_texts(readers.vignettes(spark, vignette_file(tmp_path / f"{bad[0]}{bad[1]}.json", bad))).collect()
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(Exception):
        readers.vignettes(spark, str(tmp_path / "none.json")).collect()


def test_range_windows(spark):
    turns = spark.createDataFrame([(1, k, "r", f"t{k}") for k in range(5)], "conv_id int, turn int, role string, text string")
    spans = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 4, 9)], "conv_id int, window_id string, start_turn int, end_turn int")
    assert {r["window_id"]: r["query"] for r in windows.range_windows(spans, turns).collect()} == {"a": "r: t1\nr: t2", "b": "r: t4"}


def test_whole_experiment(spark, tmp_path):
    text = "\n\n".join(f"Part {n} speaks of two things and three more things, " + " ".join(f"w{n}x{k}" for k in range(60)) + "." for n in range(12))
    files = spark.createDataFrame([("book", "Book", "book_ch1.words.txt", 0, text), ("book", "Book", "book_ch2.words.txt", 1, text[:900])], "doc_id string, doc_title string, source_file string, source_file_index int, text string")
    built = corpus.build(files, str(tmp_path / "corpus"))
    assert built.nodes.count() == 2 and built.chunks.select("book_order").distinct().count() == 1
    embedded = corpus.embed(built.chunks, str(tmp_path / "embedded"))
    assert sinks.manifest(embedded).where("vector_size = 64").count() == 4
    assert corpus.index(built.chunks, "small_fixed", str(tmp_path / "index")).postings.count() > 0
    v = readers.vignettes(spark, vignette_file(tmp_path / "v.json"))
    runs = experiment.run(v, built.chunks).persist()
    got = {r["condition"]: r for r in runs.collect()}
    assert set(got) == {"small_fixed", "medium_overlap", "hierarchical"} and got["hierarchical"]["source_file"] == "v001__w1__hierarchical.json"
    assert "Parent trace" in got["hierarchical"]["prompt"]["user_prompt"] and "Parent trace" not in got["small_fixed"]["prompt"]["user_prompt"]
    assert got["small_fixed"]["generated_response"].startswith("[MOCK OUTPUT]") and "Book / CH1" in got["small_fixed"]["generated_response"]
    sinks.write_json_lines(runs.drop("likely_parts"), str(tmp_path / "runs"))
    lines = [x for p in (tmp_path / "runs").glob("part-*") for x in p.read_text().splitlines()]
    (tmp_path / "files").mkdir()
    for n, x in enumerate(lines):
        (tmp_path / "files" / f"{n}.json").write_text(x)
    sheet = scoring.score_template(readers.runs(spark, str(tmp_path / "files")))
    assert sheet.count() == 3 and all(" :: " in r["top_sources"] for r in sheet.collect())
    sinks.write_sheet(sheet, str(tmp_path / "sheet"))
    assert readers.sheet(spark, str(tmp_path / "sheet")).count() == 3
    with pytest.raises(ValueError):
        prompts.generate(runs, "nobody")
    with pytest.raises(ValueError):
        sinks.write_sheet(sheet.limit(0), str(tmp_path / "empty"))


def test_empty_hits_and_slugs(spark):
    none = F.array().cast("array<struct<rank:int,chunk_id:string,source_title:string,section_path_str:string,parent_id:string,text:string>>")
    r = spark.range(1).select(prompts.context_block(none), prompts.mock_generator(none), prompts.validation_slug(F.lit("  What? é! ")), prompts.validation_slug(F.lit("?"))).first()
    assert r[0] == "" and "N/A / N/A" in r[1] and r[2] == "what__é" and r[3] == "retrieval_validation"


def test_summary_and_grades(spark):
    rows = [("a", "4", "2"), ("a", "3", ""), ("a", "2", "1"), ("b", "", "")]
    df = spark.createDataFrame(rows, "condition string, ifs_adherence_score string, grounding_score string")
    got = {r["condition"]: tuple(r)[1:] for r in scoring.score_summary(df).collect()}
    assert got == {"a": (3, 2, 3.0, 1.5), "b": (1, 0, None, None)}
    sheet = spark.createDataFrame([("v001__w1.json", "c", "work failure", "A part may protect you; stay curious about failure.", "T | S ; T | S2"), ("x", "c", None, "[MOCK OUTPUT]", ""), ("x", "c", None, None, None)], "file string, condition string, query string, generated_response string, top_retrieval_sources string")
    graded = {r["file"] + str(r["generated_response"] is None): r for r in scoring.auto_grade(sheet).collect()}
    r = graded["v001__w1.jsonFalse"]
    assert (r["ifs_adherence_score"], r["grounding_score"], r["specificity_score"], r["genericity_flag"], r["hallucination_flag"]) == (4, 2, 2, "no", "no")
    assert r["notes"] == "strong IFS framing; could be more case-specific" and len(graded) == 2


def test_reports(spark):
    rows = [("w1", "small_fixed", 1, None, 2, 3), ("w1", "hierarchical", 5, 5, 5, 5), ("w2", "small_fixed", 2, 2, 2, 2), ("w2", "medium_overlap", 2, 2, 2, 2), ("w3", "hierarchical", None, None, None, None)]
    df = spark.createDataFrame(rows, "window_id string, condition string, " + ", ".join(f"{m} int" for m in scoring.METRICS))
    assert {r["condition"]: r["wins"] for r in reports.win_counts(df).collect()} == {"small_fixed": 1, "medium_overlap": 0, "hierarchical": 2}
    means = reports.metric_means(df)
    assert {r["condition"]: r["grounding_score"] for r in means.collect()} == {"small_fixed": 2.0, "medium_overlap": 2.0, "hierarchical": 5.0}
    assert reports.heatmap(df).count() == 4 and reports.radar(means).count() == 12 and reports.long_form(df, ["window_id"]).count() == 20
    box = {r["condition"]: r for r in reports.box_statistics(df).collect()}
    assert box["small_fixed"]["median"] == 2.0 and box["hierarchical"]["low"] == 5.0
    assert reports.known_metric(means, "grounding_score").count() == 3


def test_sources(spark, tmp_path):
    folder = tmp_path / "My_Book"
    folder.mkdir()
    for n in (10, 2):
        (folder / f"ch{n}.words.txt").write_text(f"text {n}")
    files = readers.books(readers.text_files(spark, str(tmp_path), "*.words.txt"), {"my_book": "The Title"})
    assert [(r["doc_id"], r["doc_title"], r["source_file"], r["source_file_index"]) for r in files.orderBy("source_file_index").collect()] == [("my_book", "The Title", "ch2.words.txt", 0), ("my_book", "The Title", "ch10.words.txt", 1)]
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        readers.text_files(spark, str(folder), "bad.txt", strict=True).collect()
    assert readers.text_files(spark, str(folder), "bad.txt").count() == 1
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "a", "text": "x"}\n\n{"chunk_id": "b"}\n')
    (tmp_path / "b.json").write_text('{"items": [{"chunk_id": "c"}]}')
    (tmp_path / "c.json").write_text('[{"chunk_id": "d"}, {"chunk_id": "e"}]')
    (tmp_path / "d.json").write_text("{}")
    assert [readers.rows_anywhere(spark, str(tmp_path / f)).count() for f in ("a.jsonl", "b.json", "c.json")] == [2, 1, 2]
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl")).first()["source_jsonl"] == "a.jsonl"
    for bad in ("d.json",):
        with pytest.raises(Exception):
            readers.rows_anywhere(spark, str(tmp_path / bad)).collect()
    (tmp_path / "e.jsonl").write_text("not json\n")
    with pytest.raises(Exception):
        readers.rows_anywhere(spark, str(tmp_path / "e.jsonl")).collect()
    with pytest.raises(ValueError):
        readers.partition(spark, "x", "other")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_new(df.limit(1), str(tmp_path / "t"), "k")
    sinks.write_new(df, str(tmp_path / "t"), "k")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
    assert spark.range(1).select(sinks.extraction_header(F.lit(None).cast("string"), F.lit("f.pdf"), "words")).first()[0].count("\n") == 7


def test_pdf_reader_is_pluggable(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"hello page")
    reader = lambda content: [(1, 100.0, [(1, 20, 5, 30, w, 0, 0, n) for n, w in enumerate(content.decode().split())])]
    words = pdf.pdf_words(readers.binary_files(spark, str(tmp_path)), reader)
    assert [r["token"] for r in words.orderBy("word_no").collect()] == ["hello", "page"]


def test_streaming_summary(spark, tmp_path):
    source = tmp_path / "in"
    header = [c.strip().split()[0] for c in readers.SCORES.split(",")]
    rows = [(c, a, g) for c, a, g in (("a", "4", "2"), ("a", "2", ""), ("b", "1", "1"))]
    df = spark.createDataFrame(rows, "condition string, ifs_adherence_score string, grounding_score string").select(*(F.col(c) if c in ("condition", "ifs_adherence_score", "grounding_score") else F.lit("").alias(c) for c in header))
    sinks.write_sheet(df, str(source))
    query = streaming.start(streaming.summarize(streaming.sheets(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert {r["condition"]: r["scored_outputs"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 1, "b": 1}


def test_windows_of_any_length_meet_their_turns(spark):
    rng = random.Random(5)
    turns = [(c, rng.randrange(-50, 400), "r", f"text {n}") for c in (1, 2, None) for n in range(120)]
    spans = [(rng.choice([1, 2, 3, None]), f"w{n}", a := rng.randrange(-60, 400), a + rng.randrange(-3, 200)) for n in range(60)]
    spans += [(1, "all", -(10**15), 10**15), (2, "none", None, 5), (2, "far", 500, 10**15)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    w = spark.createDataFrame(spans, "conv_id long, window_id string, start_turn long, end_turn long")
    got = sorted((r["window_id"], r["turn"], r["text"]) for r in windows.in_ranges(w, t).collect())
    want = sorted((name, turn, text) for c, name, a, z in spans for k, turn, _, text in turns if c is not None and c == k and a is not None and a <= turn <= z)
    assert got == want and len(want) > 500
    assert windows.in_ranges(w.limit(0), t).count() == windows.in_ranges(w, t.limit(0)).count() == 0


def test_counts_are_measured_while_writing(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('chunk', id) chunk_id").repartition(7)
    assert sinks.write_json_lines(df, str(tmp_path / "lines")) == 1000 == spark.read.json(str(tmp_path / "lines")).count()
    assert sinks.write_json_lines(df.limit(10), str(tmp_path / "lines"), append=True) == 10
    assert sinks.write_json_lines(df.where("id < 0"), str(tmp_path / "none")) == 0
    chunks = spark.range(300).selectExpr("concat('d', id % 7) source_doc_id", "if(id % 2 = 0, 'small_fixed', 'medium_overlap') retrieval_setting", "cast(id as int) token_count_est")
    each, whole = sinks.write_with_manifest(chunks, str(tmp_path / "m"))
    assert whole["rows"] == 300 and whole["tokens"] == sum(range(300)) and each.count() == 14
    assert each.agg(F.sum("rows"), F.sum("tokens")).first()[:] == (300, sum(range(300)))
