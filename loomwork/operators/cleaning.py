"""Cleaning of extracted text: one chained column expression, applied without a shuffle."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import let, strip
from loomwork.operators.packing_folds import slices_from

#: What footer lines of the platform hold, whatever its case.
FOOTERS = (
    r"ProQuest\s+Ebook\s+Central",
    r"Ebook\s+Central,\s+http://ebookcentral\.proquest\.com",
    r"Created\s+from\s+buffalo\s+on",
    r"Copyright\s+©",
    r"Ebook\s+pages\s+\d+.*Printed\s+page\s+\d+",
)
#: Words that mark citation lines, in this case.
CITATIONS = ("ProQuest", "Ebook Central", "ebookcentral.proquest.com")
#: What loses a space before or after it.
CLOSE_UP = ((" ,", ","), (" .", "."), (" :", ":"), (" ;", ";"), (" !", "!"), (" ?", "?"), ("( ", "("), (" )", ")"), ("“ ", "“"), (" ”", "”"), ("‘ ", "‘"), (" ’", "’"))


def _literal(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _lines(text: Column, keep=None, change=None) -> Column:
    lines = F.split(text, "\n")
    lines = F.filter(lines, keep) if keep else F.transform(lines, change)
    return F.array_join(lines, "\n")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def remove_extraction_metadata(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)=== SOURCE METADATA ===.*?=== BEGIN EXTRACTED TEXT ===\s*", "")


def remove_page_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\n*=== PAGE \d+ ===\n*", "\n\n")


def _where(condition: Column, text: Column, changed: Column) -> Column:
    """``changed`` where one quick look finds what it may change, else the text as it is; a null text stays null."""
    return F.when(condition, changed).otherwise(text)


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def remove_footers(text: Column) -> Column:
    """The lines around each footer become empty. Matches begin at line starts, lest long lines are tried from every place."""

    def emptied(t: Column) -> Column:
        # every footer begins with a word of its own, which most texts don't hold
        words = sorted({re.match(r"\w+", p).group().lower() for p in FOOTERS})
        return _where(_any(F.lower(t), words), t, reduce(lambda x, p: F.regexp_replace(x, rf"(?idm)^.*{p}.*", ""), FOOTERS, t))

    return let(text, emptied)


def remove_citation_lines(text: Column) -> Column:
    return let(text, lambda t: _where(_any(t, CITATIONS), t, _lines(t, keep=lambda x: ~_any(x, CITATIONS))))


def remove_symbol_lines(text: Column) -> Column:
    """Lines of nothing but bullets, dashes and stops go; blank ones stay."""
    marks = "[•o\\-–—.,;:()\"'`]+"

    def kept(t: Column) -> Column:
        keep = lambda x: let(strip(x), lambda y: (y == "") | ~y.rlike(rf"\A{marks}\z"))
        return _where(t.rlike(rf"(?Um)^\s*{marks}\s*$"), t, _lines(t, keep=keep))

    return let(text, kept)


def join_split_marks(text: Column) -> Column:
    """Line breaks after an opening bracket or quote and before a closing one go."""
    opened = F.regexp_replace(text, '([(\\[{"“‘])\\s*\\n\\s*', "$1")
    return F.regexp_replace(opened, '\\s*\\n\\s*([)\\]}"”’])', "$1")


def normalize_bullets(text: Column) -> Column:
    """``• x`` and ``o x`` become ``- x`` and ``  - x`` behind as many spaces as the line was indented by."""

    def change(x: Column) -> Column:
        body = F.regexp_replace(x, r"(?U)^\s+", "")
        indent = F.repeat(F.lit(" "), F.length(x) - F.length(body))
        rest = body.substr(F.lit(3), F.length(body))
        return F.when(body.startswith("• "), F.concat(indent, F.lit("- "), rest)).when(body.rlike(r"\Ao\s+"), F.concat(indent, F.lit("  - "), rest)).otherwise(x)

    return let(text, lambda t: _where(t.rlike(r"(?Um)^\s*[•o]\s"), t, _lines(t, change=change)))


def fix_spacing(text: Column) -> Column:
    t = _literal(F.regexp_replace(text, "[ \t]+", " "), CLOSE_UP)
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "\n[ \t]+", "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


STEPS = (normalize_newlines, remove_extraction_metadata, remove_page_markers, remove_footers, remove_citation_lines, remove_symbol_lines, join_split_marks, normalize_bullets, fix_spacing)


def clean_text(text: Column) -> Column:
    """All steps in their order."""
    return reduce(lambda t, step: step(t), STEPS, text)


def merge_stacked_headings(text: Column) -> Column:
    """Runs of heading fragments on lines of their own, 80 characters in all at most, become one line (an extra step)."""
    # fixed values: the pattern of a fragment, its length, and that of a run
    fragment = lambda x: (F.length(x) <= 40) & x.rlike("\\A[A-Za-z&,\\-–—'\"“”‘’:\\s]+\\z") & x.rlike("[A-Za-z]") & (~x.rlike("[a-z]") | ~(x.rlike(r"(^|[^\p{L}])\p{Ll}") | x.rlike(r"\p{L}\p{Lu}")))

    def joined(run: Column) -> Column:
        one = F.regexp_replace(F.array_join(F.transform(run, lambda r: r["line"]), " "), r"\b([A-Z])\s+([A-Z]{2,})\b", "$1$2")
        one = F.regexp_replace(one, r"\b([A-Z])\s+(?=[A-Z]\b)", "$1")
        size = F.aggregate(run, F.lit(0), lambda a, r: a + F.length(r["line"]))
        stacked = run[0]["heading"] & (F.size(run) >= 2) & (size <= 80)
        return F.when(stacked, one).otherwise(F.array_join(F.transform(run, lambda r: r["line"]), "\n"))

    def merged(rows: Column) -> Column:
        goes_on = lambda r, i: (i > 0) & r["heading"] & F.get(rows, i - 1)["heading"]
        starts = F.filter(F.transform(rows, lambda r, i: F.when(~F.coalesce(goes_on(r, i), F.lit(False)), i)), lambda i: i.isNotNull())
        return F.array_join(slices_from(rows, starts, joined), "\n")

    lines = F.transform(F.split(text, "\n"), lambda x: let(strip(x), lambda y: F.struct(F.when(fragment(y), y).otherwise(x).alias("line"), fragment(y).alias("heading"))))
    return let(lines, merged)


def clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its text cleaned; null texts stay null."""
    return df.withColumn(text_col, clean_text(F.col(text_col)))


def clean_line(text: Column) -> Column:
    """A line put together from words: spaces before stops and around hyphens and apostrophes go."""
    pairs = (*CLOSE_UP[:8], (" ’ ", "’"), (" ' ", "'"), (" - ", "-"))
    return strip(F.regexp_replace(_literal(text, pairs), r"(?U)\s+", " "))


def normalize_extracted(text: Column) -> Column:
    t = F.replace(normalize_newlines(text), F.lit("\u00a0"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))
