"""Lengths and digests of whole text files that are read in pieces."""

import hashlib

from pyspark.sql import functions as F

from loomwork import file_queries
from loomwork.sources import readers


def test_files_in_pieces_give_what_whole_ones_do(spark, tmp_path):
    """Files of several blocks, with and without a last line end, of one line, with other line ends and bytes that aren't UTF-8."""
    texts = {"a/long.txt": b"".join(b"line %d \xc3\xa4\r\n" % k for k in range(40_000)), "a/open.txt": b"x\ny", "b/one.txt": b"z" * 300_000 + b"\n", "b/bad.txt": b"a\xffb\r\xc3\n\xe2\x82", "c/empty.txt": b"", "c/blank.txt": b"\n\n", "c/no.md": b"left out"}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r["source_file"]: (r["chars"], r["text_md5"]) for r in readers.text_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    want = {r["source_file"]: (r["chars"], r["md5"]) for r in readers.text_files(spark, str(tmp_path)).select("source_file", F.length("text").alias("chars"), F.md5("text").alias("md5")).collect()}
    assert len(want) == 5 and got == want  # empty files have no row in either
    assert got["long.txt"][1] == hashlib.md5(texts["a/long.txt"]).hexdigest()


def test_books_are_read_in_pieces(spark):
    """No row of the query of books holds a whole book."""
    plan = file_queries.text_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "wholetext" not in plan.lower()
