"""Manifests find their files by ranked rules."""

import pytest
from pyspark.sql import functions as F

from loomwork.sources import catalogue


def put(path, *ids):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f'{{"chunk_id": "{k}", "token_count_est": 3}}\n\n' for k in ids))
    return str(path)


def test_the_four_rules_and_what_they_read(spark, tmp_path):
    root, m = tmp_path / "root", tmp_path / "root" / "manifests" / "m.json"
    whole = put(root / "x" / "whole.jsonl", "a", "b")
    put(root / "out" / "beside.jsonl", "c")
    put(root / "p" / "local.jsonl", "d")
    put(root / "p" / "deep" / "er" / "lost.jsonl", "e")
    put(root / "p" / "deep" / "local.jsonl", "never")
    put(root / "q" / "lost.jsonl", "other partition")
    names = [whole, "../out/./beside.jsonl", "/elsewhere/p/local.jsonl", "C/lost.jsonl"]
    asked = spark.createDataFrame([(str(m), "p", n) for n in names + names[:1]], "manifest string, partition string, name string")
    found = catalogue.resolve(asked, catalogue.files(spark, str(root)), str(root))
    assert {r["name"]: r["rule"] for r in found.collect()} == {n: k for k, n in enumerate(names)}
    got = catalogue.read(spark, found, str(root))
    assert sorted(r["chunk_id"] for r in got.collect()) == ["a", "b", "c", "d", "e"]
    assert got.where(F.col("chunk_id") == "b").first()["source_jsonl"] == whole
    gone = spark.createDataFrame([(str(m), "p", "gone.jsonl")], asked.schema)
    with pytest.raises(Exception, match="no file for gone.jsonl of partition p"):
        catalogue.resolve(gone, catalogue.files(spark, str(root)), str(root)).collect()


def test_entries_of_a_manifest(spark):
    outputs = {"small_fixed": "s", "medium_overlap": "m", "hierarchical_parents": "p", "hierarchical_children": "c", "more": "x"}
    rows = spark.createDataFrame([("/m.json", outputs)], "manifest string, outputs map<string,string>")
    assert sorted((r["partition"], r["name"]) for r in catalogue.entries(rows).collect()) == [("hierarchical_child", "c"), ("hierarchical_parent", "p"), ("medium_overlap", "m"), ("small_fixed", "s")]
    for bad in (rows.limit(0), rows.withColumn("outputs", F.create_map(F.lit("small_fixed"), F.lit("s")))):
        with pytest.raises(ValueError, match="names no file"):
            catalogue.entries(bad)


def test_plain_paths(spark):
    shown = {"file:///a/b": "/a/b", "file:/a/./b": "/a/b", "/a/../b//c": "/b/c", "s3://k/a/../b": "s3://k/b", "x/y": "x/y"}
    rows = spark.createDataFrame([(k,) for k in shown], "p string").select("p", catalogue.plain_path(F.col("p")).alias("q"))
    assert {r["p"]: r["q"] for r in rows.collect()} == shown
