"""Score sheets, summaries by condition, and an automatic grader, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import preview
from loomwork.functions.words import BAD_CLAIMS, CASE_THEMES, CORE_TERMS, GENERIC_PHRASES, PATHOLOGIZING, SOURCE_MARKERS, SPECIFIC_SIGNALS

#: What raters judge, and the most that each rubric gives.
ADHERENCE_RUBRIC = {
    "parts_language": "Uses parts-based framing rather than treating the pattern as the whole self.",
    "curiosity": "Shows curiosity toward the protective part rather than fighting or shaming it.",
    "non_pathologizing": "Uses compassionate, non-moralizing, non-diagnostic language.",
    "ifs_alignment": "Suggests an IFS-consistent understanding or next step.",
}
GROUNDING_RUBRIC = {
    0: "Unsupported or mostly generic; not clearly tied to retrieved passages.",
    1: "Partially grounded; some clear overlap with retrieved material.",
    2: "Strongly grounded; response is well supported by retrieved passages.",
}
ADHERENCE_MAX, GROUNDING_MAX = 4, 2
METRICS = ["ifs_adherence_score", "grounding_score", "specificity_score", "retrieval_relevance_score"]
MANUAL = ["parts_language", "curiosity", "non_pathologizing", "ifs_alignment", "ifs_adherence_score", "grounding_score", "failure_notes", "reviewer"]


def top_sources(hits: Column, inner: str = " :: ", outer: str = " | ", title: str = "UNKNOWN_TITLE", section: str = "UNKNOWN_SECTION") -> Column:
    """The first three hits' titles and sections."""
    return F.array_join(F.transform(F.slice(hits, 1, 3), lambda h: F.concat(F.coalesce(h["source_title"], F.lit(title)), F.lit(inner), F.coalesce(h["section_path_str"], F.lit(section)))), outer)


def score_template(runs: DataFrame) -> DataFrame:
    """A sheet for raters: previews, sources, and empty columns to fill in."""
    kept = ["vignette_id", "window_id", "condition", "target_ifs_goal", "expected_retrieval_theme"]
    return runs.select(
        "source_file", *kept, preview(F.col("query"), 300).alias("query_preview"), preview(F.col("generated_response"), 500).alias("response_preview"), top_sources(F.col("hits")).alias("top_sources"),
        *(F.lit("").alias(c) for c in MANUAL),
    )


def grade_template(runs: DataFrame) -> DataFrame:
    """The sheet that the automatic grader reads."""
    return runs.select(F.col("source_file").alias("file"), "condition", "query", "generated_response", top_sources(F.col("hits"), " | ", " ; ", "", "").alias("top_retrieval_sources"))


def whole_number(text: Column) -> Column:
    """A score as a number, blank as null; anything else is an error."""
    return F.nullif(F.trim(text.cast("string")), F.lit("")).cast("int")


def score_summary(scored: DataFrame) -> DataFrame:
    """Per condition: outputs, those with both scores, and the means (three places) over these."""
    a, g = whole_number(F.col("ifs_adherence_score")), whole_number(F.col("grounding_score"))
    both = a.isNotNull() & g.isNotNull()
    return scored.groupBy("condition").agg(
        F.count("*").alias("total_outputs"), F.count_if(both).alias("scored_outputs"), F.round(F.avg(F.when(both, a)), 3).alias("mean_ifs_adherence"), F.round(F.avg(F.when(both, g)), 3).alias("mean_grounding")
    )


def folded(text: Column, missing: str = "nan") -> Column:
    """Lower case; a missing value reads as ``nan``, as a sheet has it."""
    return F.lower(F.coalesce(text, F.lit(missing)))


def hits_of(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur anywhere in the text, inside words too."""
    return reduce(lambda a, b: a + b, (text.contains(t).cast("int") for t in terms), F.lit(0))


def any_of(text: Column, terms: list[str]) -> Column:
    return hits_of(text, terms) > 0


def _points(*conditions: Column) -> Column:
    return F.least(F.lit(5), reduce(lambda a, c: a + c.cast("int"), conditions, F.lit(1)))


def adherence(response: Column) -> Column:
    r = folded(response)
    protects = r.contains("protect") | r.contains("positive intention")
    return _points(r.contains("part"), protects, r.contains("curious") | r.contains("curiosity"), (hits_of(r, CORE_TERMS) >= 6) & ~any_of(r, PATHOLOGIZING))


def grounding(response: Column, sources: Column) -> Column:
    r, s = folded(response), folded(sources)
    return _points(F.length(F.trim(s)) > 20, s.contains(";"), r.contains("grounding notes"), any_of(r, SOURCE_MARKERS))


def case_of(file: Column, query: Column) -> Column:
    found = lambda x: F.nullif(F.regexp_extract(folded(x), r"v\d{3}", 0), F.lit(""))
    return F.coalesce(found(file), found(query), F.lit(""))


def _theme_hits(text: Column, case: Column) -> Column:
    hits = F.lit(0)
    for name, terms in CASE_THEMES.items():
        hits = F.when(case == name, hits_of(text, terms)).otherwise(hits)
    return hits


def _long_words(text: Column, least: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-zA-Z]{%d,})" % least), F.lit(1)))


def specificity(file: Column, query: Column, response: Column) -> Column:
    r, q = folded(response), folded(query)
    themes, overlap = _theme_hits(r, case_of(file, query)), F.size(F.array_intersect(_long_words(q, 5), _long_words(r, 5)))
    return _points(themes >= 1, themes >= 3, overlap >= 5, overlap >= 10)


def retrieval_relevance(file: Column, query: Column, sources: Column) -> Column:
    s, q = folded(sources), folded(query)
    themes, words = _theme_hits(s, case_of(file, query)), F.size(F.filter(_long_words(q, 6), lambda w: s.contains(w)))
    return _points(F.length(F.trim(s)) > 20, s.contains(";"), (themes >= 1) | (words >= 1), (themes >= 2) | (words >= 3))


def is_generic(response: Column) -> Column:
    r = folded(response)
    return F.when((hits_of(r, GENERIC_PHRASES) >= 4) & (hits_of(r, SPECIFIC_SIGNALS) <= 1), "yes").otherwise("no")


def is_hallucinated(response: Column) -> Column:
    return F.when(any_of(folded(response), BAD_CLAIMS), "yes").otherwise("no")


def auto_grade(sheet: DataFrame, reviewer: str = "auto_eval_v2") -> DataFrame:
    """``sheet`` with four scores from 1 to 5, two flags, notes and reviewer. Mock answers are left out."""
    rows = sheet.where(~F.coalesce(F.col("generated_response").contains("[MOCK OUTPUT]"), F.lit(False)))
    file, query, response, sources = (F.col(c) for c in ("file", "query", "generated_response", "top_retrieval_sources"))
    rows = rows.withColumns(
        {
            "ifs_adherence_score": adherence(response),
            "grounding_score": grounding(response, sources),
            "specificity_score": specificity(file, query, response),
            "retrieval_relevance_score": retrieval_relevance(file, query, sources),
            "genericity_flag": is_generic(response),
            "hallucination_flag": is_hallucinated(response),
        }
    )
    notes = [
        F.when(F.col("ifs_adherence_score") >= 4, "strong IFS framing"),
        F.when(F.col("grounding_score") >= 4, "explicit grounding behavior"),
        F.when(F.col("specificity_score") <= 2, "could be more case-specific"),
        F.when(F.col("genericity_flag") == "yes", "some template-like phrasing"),
        F.when(F.col("hallucination_flag") == "yes", "possible unsupported claim"),
    ]
    return rows.withColumns({"notes": F.concat_ws("; ", *notes), "reviewer": F.lit(reviewer)})
