from pyspark.sql import functions as F

from loomwork.operators import cleaning, layout


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_all_steps(spark):
    raw = "=== SOURCE METADATA ===\nfile: x\n=== BEGIN EXTRACTED TEXT ===\n\n=== PAGE 1 ===\nHello ,  world .\r\nx ProQuest Ebook Central y\n•\n• item\no  sub\n(\nthe\n) end\n\n\n\n=== PAGE 2 ===\nlast"
    assert one(spark, cleaning.clean_text, raw) == "Hello, world.\n\n- item\n- sub\nthe) end\n\nlast"


def test_footers_span_lines_and_null_stays(spark):
    assert one(spark, cleaning.remove_footers, "a\nb ProQuest\nEbook Central c\nd") == "a\n\nd"
    assert one(spark, cleaning.remove_footers, "x COPYRIGHT © 2001 y\nz") == "\nz"
    assert one(spark, cleaning.clean_text, None) is None


def test_citations_are_case_sensitive(spark):
    assert one(spark, cleaning.remove_citation_lines, "a\nsee ProQuest\nproquest\n\nEbook Central") == "a\nproquest\n"


def test_stacked_headings(spark):
    assert one(spark, cleaning.merge_stacked_headings, "T HE\nNATURE\nplain text here.\nEND") == "THE NATURE\nplain text here.\nEND"


def words(spark, lines):
    rows = []
    for block, line, y, text in lines:
        rows += [("f", 1, 100.0, 10.0 * k, y, 10.0 * k + 9, y + 8.0, w, block, line, k) for k, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "file string, page int, page_height double, x0 double, y0 double, x1 double, y1 double, token string, block_no int, line_no int, word_no int")


def test_words_to_paragraphs(spark):
    lines = [(0, 0, 10.0, "CHAPTER ONE"), (1, 0, 20.0, "it begins here and"), (1, 1, 29.0, "goes on ."), (2, 0, 60.0, "Then more text follows"), (2, 1, 69.0, "see Copyright notice"), (3, 0, -4.0, "in the margin")]
    got = layout.lines_to_paragraphs(layout.words_to_lines(words(spark, lines))).orderBy("paragraph_no").collect()
    assert [r["text"] for r in got] == ["CHAPTER ONE", "it begins here and goes on.", "Then more text follows"]


def test_page_markers_flush_but_are_no_predecessor(spark):
    lines = [(0, 0, 10.0, "some words"), (0, 1, 19.0, "=== page 3 ==="), (0, 2, 28.0, "more words")]
    got = layout.lines_to_paragraphs(layout.words_to_lines(words(spark, lines))).orderBy("paragraph_no").collect()
    assert [r["text"] for r in got] == ["some words", "more words"]


def test_extract_modes(spark):
    w = words(spark, [(0, 0, 10.0, "plain words here")])
    assert layout.extract_text(w).first()["text"] == "=== PAGE 1 ===\nplain words here"
    pages = spark.createDataFrame([("f", 2, "b"), ("f", 1, " a "), ("f", 3, " ")], "file string, page int, text string")
    assert layout.extract_text(pages, "text", False).first()["text"] == "a\n\nb"
    blocks = spark.createDataFrame([("f", 1, 100.0, 5.0, 50.0, 9.0, 60.0, "low"), ("f", 1, 100.0, 5.0, 10.0, 9.0, 20.0, "high")], "file string, page int, page_height double, x0 double, y0 double, x1 double, y1 double, text string")
    assert layout.extract_text(blocks, "blocks", False).first()["text"] == "high\n\nlow"
    try:
        layout.extract_text(pages, "nonsense")
        raise AssertionError
    except ValueError:
        pass
