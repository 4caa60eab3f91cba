"""Which benchmark items auto_grade meets."""

from loomwork.queries import QUERIES, benchmark_queries


def test_all_documents_are_graded_and_nothing_is_forced_to_be_broadcast(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["auto_grade"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").where("not coalesce(contains(text, '[MOCK OUTPUT]'), false)").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan and "LeftOuter" in plan
    assert benchmark_queries(spark, sf).count() > 20
