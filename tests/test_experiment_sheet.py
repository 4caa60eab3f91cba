"""The experiment through its files equals the experiment's plan."""

from loomwork import file_queries
from loomwork.operators import chunking, scoring, windows
from loomwork.plans import experiment
from loomwork.queries import units

SF = "/root/testdata/sf0.001"


def test_run_files_hold_what_the_plan_gives(spark):
    got = {r["source_file"]: r for r in file_queries.experiment_sheet(spark, SF).collect()}
    vignettes = file_queries._vignettes(spark, SF, file_queries._folder(spark, "v"))
    n = windows.window_texts(vignettes).count()
    chunks = windows.written(chunking.chunk_corpus(units(spark, SF)))
    runs = experiment.run(vignettes, chunks)
    plain = runs.select("source_file", "condition", "query", scoring.top_sources(runs["hits"] if "hits" in runs.columns else scoring.F.coalesce("retrieval.child_results", "retrieval.results")).alias("top")).collect()
    assert set(got) == {r["source_file"] for r in plain} and len(plain) > n
    for r in plain:
        row = got[r["source_file"]]
        assert row["condition"] == r["condition"] and row["top_sources"] == r["top"] and row["query_preview"][:20] == " ".join(r["query"].split())[:20]
        assert (row["n_parents"] > 0) == (r["condition"] == "hierarchical") and row["source_file"] == f"{row['vignette_id']}__{row['window_id']}__{row['condition']}.json".replace("V", "v").replace("W", "w")
