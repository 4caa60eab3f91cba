"""The summary of corrected sheets equals the batch over the latest rows, in any order of arrival."""

import random

from pyspark.sql import functions as F

from loomwork.operators import scoring
from loomwork.streaming import latest

rank = lambda row: (row[1], row[2] is not None, row[2] or 0, row[3] is not None, row[3] or 0, row[0] is not None, row[0] or "")
SCHEMA = "source_file string, condition string, version long, ifs_adherence_score string, grounding_score string"


def test_late_and_corrected_sheets(spark, tmp_path):
    rng, source = random.Random(3), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    rows = [(rng.choice([*(f"f{k}" for k in range(12)), None]), rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["", "1", "4", " 3 ", None]), rng.choice(["", "2", "5", None])) for _ in range(90)]
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    best = {}
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        latest.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
        number = lambda x: int(x) if x and x.strip() else None
        for f, c, v, a, g in rows[n * 30 : n * 30 + 30]:
            if f is not None and v is not None:
                row = (c, v, number(a), number(g))
                best[f] = max(best.get(f, row), row, key=rank)
        want = scoring.score_summary(spark.createDataFrame([(f, c, v, str(a or ""), str(g or "")) for f, (c, v, a, g) in best.items()], SCHEMA))
        got = latest.summary(spark, str(tmp_path / "out"))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    sizes = spark.read.parquet(str(tmp_path / "out")).groupBy("batch").agg(F.count("*").alias("n"), F.sum("outputs").alias("o")).collect()
    assert len(sizes) >= 3 and max(r["n"] for r in sizes) <= 3 and sum(r["o"] for r in sizes) == len(best)
