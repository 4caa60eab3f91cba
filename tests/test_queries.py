"""Every registered query with SQL against that SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.oracles import ORACLES
from loomwork.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no tables")


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "score"]
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_structured_corpus_covers_all_documents(spark):
    rows = QUERIES["structured_corpus"](spark, SF)
    assert rows.select("retrieval_setting").distinct().count() == 4 and rows.groupBy("chunk_id").count().where("count > 1").count() == 0
