"""Text measures and predicates as column expressions; all stay in the JVM.

Words are runs of letters, digits and underscores in any script. Nulls give nulls unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TOKENS_PER_WORD = 1.3
#: Abbreviated typographic characters and what they become (the soft hyphen goes).
TYPOGRAPHIC = ("\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u00ad", "''\"\"-- ")


def let(value: Column, body) -> Column:
    """``body(value)`` in which ``value`` is computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def tokens_of_words(words: Column) -> Column:
    """Estimated tokens: 1.3 for a word, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.rint(words * F.lit(TOKENS_PER_WORD)).cast("int"))


def estimate_tokens(text: Column) -> Column:
    return tokens_of_words(word_count(text))


def strip(text: Column) -> Column:
    """Without white space at either end, in any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, length: int) -> Column:
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def sentences(text: Column) -> Column:
    """Parts that end after ``. ! ?`` and white space; an empty text has none."""
    flat = collapse(text)
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != "")


def slug(text: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as single underscores, none at the ends; ``unknown`` if nothing is left."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(folded == "", "unknown").otherwise(folded)


def uppercase_ratio(text: Column) -> Column:
    """Upper-case letters among the letters, 0 if there are none."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")) / F.nullif(letters, F.lit(0)), F.lit(0.0))


def is_title(text: Column) -> Column:
    """Every run of letters begins with a capital and goes on in lower case."""
    return ~(text.rlike(r"(^|[^\p{L}])\p{Ll}") | text.rlike(r"\p{L}\p{Lu}"))


def title_case(text: Column) -> Column:
    """Each run of letters capitalised; letters after an apostrophe or digit begin a run."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def looks_like_sentence(text: Column) -> Column:
    """Ends in ``. ! ?``, or has ten words of which five are in lower case."""

    def of_words(words: Column) -> Column:
        return (F.size(words) >= 10) & (F.size(F.filter(words, lambda w: w.rlike(r"\p{Ll}") & ~w.rlike(r"[\p{Lu}\p{Lt}]"))) >= 5)

    return strip(text).rlike(r"[.!?]\z") | let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), of_words)


def is_likely_header(text: Column) -> Column:
    """1 to 14 words in at most 100 characters, no sentence, mostly capitals or in title case."""

    def of_stripped(t: Column) -> Column:
        words = word_count(t)
        shouted = t.rlike(r"\A[A-Z\s\-:&]+\z") & (words <= 12)
        return words.between(1, 14) & ~looks_like_sentence(t) & ~t.rlike(r"[.!?;]\z") & ((uppercase_ratio(t) > 0.60) | is_title(t) | shouted)

    # most texts are too long, which their length tells at once
    return let(strip(text), lambda t: F.when(F.length(t) > 100, F.lit(False)).otherwise(of_stripped(t)))


def is_substantial(text: Column, least: int = 20) -> Column:
    return word_count(text) >= least


def is_noise_header(text: Column) -> Column:
    """Two short tokens in capitals and more capitals than other letters."""
    tokens = F.split(collapse(text), " ")
    short = F.size(F.filter(tokens, lambda w: (F.length(w) <= 3) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")))
    return (short >= 2) & (uppercase_ratio(text) > 0.5)


def paragraph_type(text: Column, header: Column) -> Column:
    """``empty, headed_body, list_item, numbered_item, exercise_or_prompt`` or ``body``; ``header`` is null without one."""
    t = strip(text)
    return (
        F.when(t == "", "empty")
        .when(header.isNotNull() & (header != "") & (word_count(header) <= 12), "headed_body")
        .when(t.rlike(r"\A(?d)[-*\u2022].+\z"), "list_item")
        .when(t.rlike(r"\A\d+\."), "numbered_item")
        .when((F.regexp_count(t, F.lit(r"\?")) >= 2) & (word_count(t) < 120), "exercise_or_prompt")
        .otherwise("body")
    )


def is_page_marker(text: Column) -> Column:
    return strip(text).rlike(r"(?i)\A=+\s*page\s+\d+\s*=+\z")


def is_heading_line(text: Column) -> Column:
    """For lines of a page: 1 to 14 words in 120 characters, a chapter line, or no sentence and capitals or title case."""
    t = strip(text)
    short = word_count(t).between(1, 14) & (F.length(t) <= 120)
    return short & (t.startswith("CHAPTER ") | (~t.rlike(r"[.!?]\z") & ((uppercase_ratio(t) > 0.60) | is_title(t))))


def ends_paragraph(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "").rlike('[.!?\u201d"]\\z')


def starts_paragraph(text: Column) -> Column:
    t = strip(text)
    return is_heading_line(t) | t.rlike('\\A[A-Z\u201c"(\\[]')


#: Phrases that mark platform lines.
BOILERPLATE = ("proquest ebook central", "created from buffalo on", "http://ebookcentral.proquest.com", "copyright")


def is_boilerplate(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def plain_characters(text: Column) -> Column:
    return F.translate(text, *TYPOGRAPHIC)


def terms(text: Column) -> Column:
    """Lower-case words of two characters and more, as a lexical index has them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
