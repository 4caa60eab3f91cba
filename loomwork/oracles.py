"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from loomwork.functions.words import BAD_CLAIMS, CASE_THEMES, CORE_TERMS, GENERIC_PHRASES, PATHOLOGIZING, SOURCE_MARKERS, SPECIFIC_SIGNALS, STOP_WORDS
from loomwork.operators.cleaning import CITATIONS, CLOSE_UP, FOOTERS
from loomwork.operators.prompts import SYSTEM_PROMPT
from loomwork.operators.scoring import METRICS
from loomwork.queries import WINDOW_TURNS, K

WORD = r"[\p{L}\p{N}_]+"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def tokens(w: str) -> str:
    return f"greatest(1, round_even({w} * 1.3::DOUBLE, 0)::INT)"


def letters(x: str, kind: str) -> str:
    return rf"len(regexp_extract_all({x}, '\p{{{kind}}}'))"


#: Lines as units: doc, d (its name), n, line, words, tokens, and offsets.
UNITS = f"""
    l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    l1 AS (SELECT doc_id, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l0),
    l2 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM l1 WHERE line <> ''),
    u AS (SELECT 'doc' || doc_id AS d, n::INT AS n, line, {tokens(words('line'))} AS t,
                 coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS a,
                 length(line) AS size FROM l2)"""


def fold(target: int, least: int, name: str = "c") -> str:
    """Windows without overlap: c has d, n, k."""
    return f"""
    {name} AS (SELECT d, n, t AS cur, 0 AS k FROM u WHERE n = 0
          UNION ALL
          SELECT u.d, u.n, CASE WHEN cur + u.t <= {target} OR cur < {least} THEN cur + u.t ELSE u.t END,
                 CASE WHEN cur + u.t <= {target} OR cur < {least} THEN k ELSE k + 1 END
          FROM {name} JOIN u ON u.d = {name}.d AND u.n = {name}.n + 1)"""


SHOWN = f"""
    SELECT d AS source_doc_id, k AS chunk_index, count(*)::INT AS n_units, min(n)::INT AS first_unit, {tokens("sum(" + words("line") + ")")} AS token_count_est,
           min(a)::INT AS char_start_in_doc, max(a + size)::INT AS char_end_in_doc, md5(string_agg(line, chr(10) || chr(10) ORDER BY n)) AS text_md5"""
SMALL = f"WITH RECURSIVE {UNITS}, {fold(350, 120)}, x AS (SELECT u.*, c.k FROM u JOIN c ON u.d = c.d AND u.n = c.n)"
#: All windows that could begin at each unit, where the next begins, and those that do.
MEDIUM = f"""WITH RECURSIVE {UNITS},
    p AS (SELECT d, n, t, sum(t) OVER (PARTITION BY d ORDER BY n) AS upto, count(*) OVER (PARTITION BY d) AS total FROM u),
    e AS (SELECT s.d, s.n AS s, any_value(s.total) AS total,
                 1 + max(x.n) FILTER (x.n = s.n OR x.upto - s.upto + s.t <= 900 OR x.upto - x.t - s.upto + s.t < 300) AS stop
          FROM p s JOIN p x ON s.d = x.d AND x.n >= s.n GROUP BY s.d, s.n),
    f AS (SELECT q.d, q.n + 1 AS stop, min(b.n) AS back FROM p q JOIN p b ON q.d = b.d AND b.n <= q.n
          WHERE b.n = q.n OR q.upto - b.upto + b.t <= 180 GROUP BY q.d, q.n),
    g AS (SELECT e.d, e.s, e.stop, e.total, CASE WHEN f.back > e.s THEN f.back ELSE greatest(e.s + 1, e.stop - 1) END AS next FROM e JOIN f ON e.d = f.d AND e.stop = f.stop),
    h AS (SELECT d, s, stop, total, next, 0 AS k FROM g WHERE s = 0
          UNION ALL SELECT g.d, g.s, g.stop, g.total, g.next, h.k + 1 FROM h JOIN g ON g.d = h.d AND g.s = h.next WHERE h.stop < h.total)"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tfidf(name: str, source: str) -> str:
    """Tables of a lexical index over ``source`` (id, text): name_tf, name_idf, name_w."""
    return f"""
    {name}_t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source}),
    {name}_tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM {name}_t WHERE term NOT IN ({_STOP}) GROUP BY ALL),
    {name}_idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM {source}) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM {name}_tf GROUP BY term),
    {name}_w AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM {name}_tf JOIN {name}_idf USING (term)),
    {name}_qt AS (SELECT item_id AS q, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark),
    {name}_qf AS (SELECT q, term, count(*)::DOUBLE AS tf FROM {name}_qt WHERE term NOT IN ({_STOP}) GROUP BY ALL),
    {name}_q AS (SELECT q, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY q)) AS w FROM {name}_qf JOIN {name}_idf USING (term)),
    {name}_s AS (SELECT q, id, round(sum({name}_q.w * {name}_w.w), 12) AS score FROM {name}_q JOIN {name}_w USING (term) GROUP BY ALL)"""


DOCS = "docs AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)"


def top(name: str, source: str, k: int, order: str = "id") -> str:
    return f"""
    {name}_r AS (SELECT b.item_id AS q, x.id, coalesce(s.score, 0) AS score,
                 row_number() OVER (PARTITION BY b.item_id ORDER BY coalesce(s.score, 0) DESC, x.{order}) AS rank
                 FROM benchmark b CROSS JOIN {source} x LEFT JOIN {name}_s s ON s.q = b.item_id AND s.id = x.id QUALIFY rank <= {k})"""


HITS = f"WITH {DOCS}, {tfidf('i', 'docs')}, {top('i', 'docs', 3)}, hits AS (SELECT i_r.q, i_r.rank, d.* FROM i_r JOIN documents d ON d.doc_id = i_r.id), conds(condition) AS (VALUES ('small_fixed'), ('medium_overlap'))"


def has(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, '{t}')::INT" for t in terms) + ")"


def points(*conditions: str) -> str:
    return "least(5, 1 + " + " + ".join(f"({c})::INT" for c in conditions) + ")"


_THEMES = lambda x: "CASE substr(file, 1, 4) " + " ".join(f"WHEN '{c}' THEN {has(x, t)}" for c, t in CASE_THEMES.items()) + " ELSE 0 END"


def clean_sql() -> str:
    steps = [("regexp_replace({}, '\\r\\n?', chr(10), 'g')",), (r"regexp_replace({}, '(?s)=== SOURCE METADATA ===.*?=== BEGIN EXTRACTED TEXT ===\s*', '', 'g')",), (r"regexp_replace({}, '\n*=== PAGE \d+ ===\n*', chr(10) || chr(10), 'g')",)]
    sql = "text"
    for (step,) in steps:
        sql = step.replace("{}", sql)
    for pattern in FOOTERS:
        sql = f"regexp_replace({sql}, '(?i).*{pattern}.*', '', 'g')"
    cites = " OR ".join(f"contains(x, '{c}')" for c in CITATIONS)
    sql = f"array_to_string(list_filter(string_split({sql}, chr(10)), lambda x: NOT ({cites})), chr(10))"
    marks = "[•o\\-–—.,;:()\"''`]+"
    sql = f"array_to_string(list_filter(string_split({sql}, chr(10)), lambda x: NOT regexp_full_match(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '{marks}')), chr(10))"
    sql = f"""regexp_replace({sql}, '([(\\[{{"“‘])\\s*\\n\\s*', '\\1', 'g')"""
    sql = f"""regexp_replace({sql}, '\\s*\\n\\s*([)\\]}}"”’])', '\\1', 'g')"""
    body = "regexp_replace(x, '^\\s+', '')"
    indent = f"repeat(' ', length(x) - length({body}))"
    sql = f"""array_to_string(list_transform(string_split({sql}, chr(10)), lambda x: CASE WHEN starts_with({body}, '• ') THEN {indent} || '- ' || substr({body}, 3)
              WHEN regexp_matches({body}, '^o\\s+') THEN {indent} || '  - ' || substr({body}, 3) ELSE x END), chr(10))"""
    sql = f"regexp_replace({sql}, '[ \\t]+', ' ', 'g')"
    for a, b in CLOSE_UP:
        sql = f"replace({sql}, '{a}', '{b}')"
    sql = f"regexp_replace(regexp_replace({sql}, '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({sql}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_UPPER = lambda x: f"coalesce({letters(x, 'Lu')}::DOUBLE / nullif({letters(x, 'L')}, 0), 0)"
_TITLE = lambda x: rf"NOT (regexp_matches({x}, '(^|[^\p{{L}}])\p{{Ll}}') OR regexp_matches({x}, '\p{{L}}\p{{Lu}}'))"
_SENTENCE = rf"(regexp_matches(line, '[.!?]$') OR ({words('line')} >= 10 AND len(list_filter(regexp_extract_all(line, '{WORD}'), lambda w: regexp_matches(w, '\p{{Ll}}') AND NOT regexp_matches(w, '[\p{{Lu}}\p{{Lt}}]'))) >= 5))"
_GRADED = f"""g AS (SELECT conv_id || '_' || turn // 3 AS window_id, ['small_fixed', 'medium_overlap', 'hierarchical'][turn::INT % 3 + 1] AS condition,
                 {', '.join(f"CASE WHEN length(text) % {3 + k} > 0 THEN (length(text) + {k}) % 5 + 1 END AS {m}" for k, m in enumerate(METRICS))} FROM conversations),
    o AS (SELECT *, list_avg(list_filter([{', '.join(METRICS)}], lambda x: x IS NOT NULL)) AS overall FROM g)"""
_DENSE = """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, {score} AS raw FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0),
    r AS (SELECT query_id, vec_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw {order}, vec_id) AS rank FROM p)
    SELECT query_id, rank::INT AS rank, vec_id, round(raw, 9) AS score FROM r WHERE rank <= {k}"""
_D = "::DOUBLE[]"

ORACLES = {
    "word_token_stats": f"""
        WITH s AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM documents)
        SELECT doc_id, {words('text')}::INT AS words, {tokens(words('text'))} AS tokens, round({_UPPER('text')}, 6) AS uppercase,
               len(list_filter(string_split(regexp_replace(flat, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::INT AS sentences FROM s""",
    "clean_documents": f"SELECT doc_id, sha256({clean_sql()}) AS clean_sha256 FROM documents",
    "header_flags": f"""
        WITH {UNITS}, f AS (SELECT d, n, line, {words('line')} AS w, {_SENTENCE} AS sentence, {_TITLE('line')} AS title FROM u)
        SELECT d AS source_doc_id, n, sentence, title,
               (w BETWEEN 1 AND 14 AND length(line) <= 100 AND NOT sentence AND NOT regexp_matches(line, '[.!?;]$')
                AND ({_UPPER('line')} > 0.60 OR title OR (regexp_full_match(line, '[A-Z\\s\\-:&]+') AND w <= 12))) AS header,
               (len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: length(x) <= 3 AND regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}'))) >= 2 AND {_UPPER('line')} > 0.5) AS noise,
               w >= 20 AS substantial, regexp_matches(line, '[.!?”"]$') AS ends FROM f""",
    "paragraph_types": f"""
        WITH {UNITS}, k AS (SELECT line, CASE WHEN regexp_full_match(line, '[-*•].+') THEN 'list_item' WHEN regexp_matches(line, '^\\d+\\.') THEN 'numbered_item'
                   WHEN length(line) - length(replace(line, '?', '')) >= 2 AND {words('line')} < 120 THEN 'exercise_or_prompt' ELSE 'body' END AS paragraph_type FROM u)
        SELECT paragraph_type, count(*) AS n, sum(length(line))::BIGINT AS chars FROM k GROUP BY ALL""",
    "char_offsets": f"WITH {UNITS} SELECT d AS source_doc_id, n, a AS char_start_in_doc, (a + size)::INT AS char_end_in_doc FROM u",
    "chunk_small_fixed": f"{SMALL} {SHOWN} FROM x GROUP BY d, k",
    "chunk_medium_overlap": f"""{MEDIUM},
        j AS (SELECT *, lag(stop) OVER w AS before, lead(s) OVER w AS after FROM h WINDOW w AS (PARTITION BY d ORDER BY k)),
        x AS (SELECT u.*, j.k, j.before, j.after FROM j JOIN u ON u.d = j.d AND u.n >= j.s AND u.n < j.stop)
        {SHOWN}, coalesce(sum(t) FILTER (n < before), 0)::INT AS overlap_with_prev_tokens, coalesce(sum(t) FILTER (n >= after), 0)::INT AS overlap_with_next_tokens
        FROM x GROUP BY d, k""",
    "hier_parents": f"""WITH RECURSIVE {UNITS}, {fold(300, 120)}, k AS (SELECT d, max(k) + 1 AS kids FROM c GROUP BY d)
        SELECT d AS source_doc_id, d || '::hier_parent::' || d || '::00000' AS chunk_id, {tokens("sum(" + words("line") + ")")} AS token_count_est,
               (sum(size) + 2 * (count(*) - 1))::INT AS char_count, any_value(kids)::INT AS n_children FROM u JOIN k USING (d) GROUP BY d""",
    "hier_children": f"""WITH RECURSIVE {UNITS}, {fold(300, 120)}, x AS (SELECT u.*, c.k FROM u JOIN c ON u.d = c.d AND u.n = c.n)
        {SHOWN}, d || '::hier_parent::' || d || '::00000' AS parent_id FROM x GROUP BY d, k""",
    "chunk_links": f"""{SMALL}, y AS (SELECT DISTINCT d, k, d || '::small_fixed::' || d || '::' || lpad(k::VARCHAR, 5, '0') AS id FROM x)
        SELECT id AS chunk_id, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id FROM y WINDOW w AS (PARTITION BY d ORDER BY k)""",
    "chunk_summary": f"""{MEDIUM}, {fold(350, 120)}, {fold(300, 120, 'c2')},
        m AS (SELECT 'small_fixed' AS r, d, k, n FROM c UNION ALL SELECT 'hierarchical_child', d, k, n FROM c2 UNION ALL SELECT 'hierarchical_parent', d, 0, n FROM u
              UNION ALL SELECT 'medium_overlap', h.d, h.k, u.n FROM h JOIN u ON u.d = h.d AND u.n >= h.s AND u.n < h.stop),
        y AS (SELECT r, {tokens("sum(" + words("line") + ")")} AS t FROM m JOIN u USING (d, n) GROUP BY r, d, k)
        SELECT r AS retrieval_setting, count(*) AS count, round(avg(t), 2) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens FROM y GROUP BY r""",
    "quality_report": f"""WITH {UNITS}, w AS (SELECT d, n, {words('line')} AS c, row_number() OVER (PARTITION BY d ORDER BY {words('line')} DESC, n) AS r FROM u)
        SELECT d AS doc_id, count(*) AS paragraphs, max(c)::INT AS max_words, count(*) FILTER (c > 300) AS over_300_words, count(*) FILTER (c > 500) AS over_500_words,
               count(*) FILTER (c > 800) AS over_800_words, string_agg(c::VARCHAR, ',' ORDER BY r) FILTER (r <= 10) AS largest FROM w GROUP BY d""",
    "tfidf_df": f"WITH {DOCS}, {tfidf('i', 'docs')} SELECT term, df, round(idf, 9) AS idf FROM i_idf",
    "tfidf_search": f"WITH {DOCS}, {tfidf('i', 'docs')}, {top('i', 'docs', K)} SELECT q AS query_id, rank::INT AS rank, id AS doc_id, round(score, 9) AS score FROM i_r",
    "tfidf_block_search": f"WITH {DOCS}, {tfidf('i', 'docs')}, {top('i', 'docs', K)} SELECT q AS query_id, rank::INT AS rank, id AS doc_id, round(score, 9) AS score FROM i_r",
    "chunk_search": f"""{SMALL}, docs AS (SELECT d || '::small_fixed::' || d || '::' || lpad(k::VARCHAR, 5, '0') AS id, (d, k) AS place, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text FROM x GROUP BY d, k),
        {tfidf('i', 'docs')}, {top('i', 'docs', 3, 'place')} SELECT q AS query_id, rank::INT AS rank, id AS chunk_id, round(score, 9) AS score FROM i_r""",
    "hier_search": f"""WITH {UNITS}, par AS (SELECT 'doc' || doc_id AS id, coalesce(text, '') AS text FROM documents), kid AS (SELECT d || '::p' || lpad(n::VARCHAR, 5, '0') || '::u00' AS id, d, n, line AS text FROM u),
        {tfidf('a', 'par')}, {top('a', 'par', 3)}, {tfidf('b', 'kid')},
        m AS (SELECT a_r.q, kid.id, kid.d, kid.n, coalesce(b_s.score, 0) AS score FROM a_r JOIN kid ON kid.d = a_r.id LEFT JOIN b_s ON b_s.q = a_r.q AND b_s.id = kid.id),
        z AS (SELECT *, row_number() OVER (PARTITION BY q, d ORDER BY score DESC, n) AS r1 FROM m QUALIFY r1 <= 2),
        y AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d, n) AS rank FROM z QUALIFY rank <= 5)
        SELECT q AS query_id, rank::INT AS rank, id AS chunk_id, d AS parent_id, round(score, 9) AS score FROM y""",
    "dense_ip_topk": _DENSE.format(score=f"list_inner_product(a.embedding{_D}, b.embedding{_D})", order="DESC", k=K),
    "dense_ip_cells": _DENSE.format(score=f"list_inner_product(a.embedding{_D}, b.embedding{_D})", order="DESC", k=K),
    "dense_l2_topk": _DENSE.format(score=f"list_sum(list_transform(list_zip(a.embedding{_D}, b.embedding{_D}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", order="ASC", k=K),
    "dense_l2_cells": _DENSE.format(score=f"list_sum(list_transform(list_zip(a.embedding{_D}, b.embedding{_D}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", order="ASC", k=K),
    "normalized_vectors": f"WITH v AS (SELECT vec_id, embedding{_D} AS e, sqrt(list_inner_product(embedding{_D}, embedding{_D})) AS n FROM embeddings) SELECT vec_id, len(e)::INT AS size, round(CASE WHEN n = 0 THEN 0 ELSE list_sum(list_transform(e, lambda x: x / n * (x / n))) END, 9) AS norm2 FROM v",
    "window_text": f"""WITH t AS (SELECT conv_id, floor(turn / {WINDOW_TURNS})::INT AS window_no, turn, trim(role) || ': ' || trim(text) AS line, trim(coalesce(text, '')) <> '' AS said FROM conversations)
        SELECT conv_id, window_no, min(turn) AS first_turn, max(turn) AS last_turn, md5(string_agg(line, chr(10) ORDER BY turn) FILTER (said)) AS query_md5 FROM t GROUP BY ALL HAVING count(*) FILTER (said) > 0""",
    "ranged_windows": """WITH w AS (SELECT conv_id, 'r' || turn AS window_id, turn AS a, turn + turn % 4 AS z FROM conversations UNION ALL SELECT DISTINCT conv_id, 'all', 0, 1000000000000 FROM conversations),
        t AS (SELECT conv_id, turn, trim(role) || ': ' || trim(text) AS line, trim(coalesce(text, '')) <> '' AS said FROM conversations)
        SELECT w.conv_id, window_id, md5(string_agg(line, chr(10) ORDER BY turn) FILTER (said)) AS query_md5 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn BETWEEN a AND z GROUP BY ALL HAVING count(*) FILTER (said) > 0""",
    "prompt_rows": f"""{HITS}, b AS (SELECT q, chr(10) || chr(10) || string_agg('[Rank ' || rank || ']' || chr(10) || 'chunk_id: doc' || doc_id || chr(10) || 'title: ' || source || chr(10) || 'section: ' || lang || chr(10)
            || 'parent_id: None' || chr(10) || 'passage:' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || repeat('-', 80) || chr(10) || chr(10) ORDER BY rank) AS block FROM hits GROUP BY q)
        SELECT 'q' || item_id || '__' || condition || '.json' AS source_file, {len(SYSTEM_PROMPT)}::INT AS system_length,
               md5('Retrieval condition: ' || condition || chr(10) || chr(10) || 'Consultation window:' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'Retrieved passages:' || block
                   || chr(10) || chr(10) || 'Write a grounded IFS-informed coaching response for this consultation window.') AS user_md5
        FROM benchmark JOIN b ON q = item_id CROSS JOIN conds""",
    "mock_generate": f"""{HITS} SELECT 'q' || q || '__' || condition || '.json' AS source_file, max(source || ' / ' || lang) FILTER (rank = 1) AS first_source,
        coalesce(max(source || ' / ' || lang) FILTER (rank = 2), 'N/A / N/A') AS second_source FROM hits CROSS JOIN conds GROUP BY q, condition""",
    "top_sources": f"{HITS} SELECT 'q' || q || '__' || condition || '.json' AS source_file, string_agg(source || ' :: ' || lang, ' | ' ORDER BY rank) AS top_sources FROM hits CROSS JOIN conds GROUP BY q, condition",
    "score_template": f"""{HITS}, s AS (SELECT q, string_agg(source || ' :: ' || lang, ' | ' ORDER BY rank) AS top_sources FROM hits GROUP BY q),
        f AS (SELECT item_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM benchmark)
        SELECT 'q' || item_id || '__' || condition || '.json' AS source_file, condition, substr(flat, 1, 300) || CASE WHEN length(flat) > 300 THEN '...' ELSE '' END AS query_preview, top_sources, '' AS ifs_adherence_score
        FROM f JOIN s ON q = item_id CROSS JOIN conds""",
    "score_summary": """
        WITH r AS (SELECT lang AS condition, quality * 3 + 1 AS a, CASE WHEN toxic = 0 THEN n_chars % 3 END AS g FROM documents JOIN labels USING (doc_id))
        SELECT condition, count(*) AS total_outputs, count(*) FILTER (a IS NOT NULL AND g IS NOT NULL) AS scored_outputs,
               round(avg(a) FILTER (g IS NOT NULL), 3) AS mean_ifs_adherence, round(avg(g) FILTER (a IS NOT NULL), 3) AS mean_grounding FROM r GROUP BY condition""",
    "auto_grade": f"""
        WITH i AS (SELECT 'v0' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '_' || doc_id AS file, lang AS condition, lower(coalesce(b.text, 'nan')) AS q, lower(coalesce(d.text, 'nan')) AS r,
                          lower(coalesce(source || ' ; ' || substr(b.text, 1, 40), 'nan')) AS s, d.text AS raw FROM documents d LEFT JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS n, text FROM benchmark) b ON b.n = d.doc_id % (SELECT count(*) FROM benchmark)),
        g AS (SELECT file, condition,
            {points("contains(r, 'part')", "contains(r, 'protect') OR contains(r, 'positive intention')", "contains(r, 'curious') OR contains(r, 'curiosity')", has('r', CORE_TERMS) + ' >= 6 AND ' + has('r', PATHOLOGIZING) + ' = 0')} AS ifs_adherence_score,
            {points("length(trim(s)) > 20", "contains(s, ';')", "contains(r, 'grounding notes')", has('r', SOURCE_MARKERS) + ' > 0')} AS grounding_score,
            {_THEMES('r')} AS rt, {_THEMES('s')} AS st, len(list_intersect(list_distinct(regexp_extract_all(q, '[a-zA-Z]{{5,}}')), list_distinct(regexp_extract_all(r, '[a-zA-Z]{{5,}}')))) AS overlap,
            len(list_filter(list_distinct(regexp_extract_all(q, '[a-zA-Z]{{6,}}')), lambda w: contains(s, w))) AS qh, length(trim(s)) AS sl, contains(s, ';') AS listed,
            CASE WHEN {has('r', GENERIC_PHRASES)} >= 4 AND {has('r', SPECIFIC_SIGNALS)} <= 1 THEN 'yes' ELSE 'no' END AS genericity_flag,
            CASE WHEN {has('r', BAD_CLAIMS)} > 0 THEN 'yes' ELSE 'no' END AS hallucination_flag FROM i WHERE NOT coalesce(contains(raw, '[MOCK OUTPUT]'), false)),
        h AS (SELECT *, {points('rt >= 1', 'rt >= 3', 'overlap >= 5', 'overlap >= 10')} AS specificity_score, {points('sl > 20', 'listed', 'st >= 1 OR qh >= 1', 'st >= 2 OR qh >= 3')} AS retrieval_relevance_score FROM g)
        SELECT file, condition, ifs_adherence_score, grounding_score, specificity_score, retrieval_relevance_score, genericity_flag, hallucination_flag,
            concat_ws('; ', CASE WHEN ifs_adherence_score >= 4 THEN 'strong IFS framing' END, CASE WHEN grounding_score >= 4 THEN 'explicit grounding behavior' END, CASE WHEN specificity_score <= 2 THEN 'could be more case-specific' END,
                CASE WHEN genericity_flag = 'yes' THEN 'some template-like phrasing' END, CASE WHEN hallucination_flag = 'yes' THEN 'possible unsupported claim' END) AS notes, 'auto_eval_v2' AS reviewer FROM h""",
    "metric_means": f"WITH {_GRADED} SELECT condition, {', '.join(f'round(avg({m}), 2) AS {m}' for m in METRICS)} FROM g GROUP BY condition",
    "overall_wins": f"""WITH {_GRADED}, p AS (SELECT *, list_position(['small_fixed', 'medium_overlap', 'hierarchical'], condition) AS place FROM o),
        b AS (SELECT condition FROM p QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY overall DESC NULLS LAST, place) = 1)
        SELECT c AS condition, count(b.condition) AS wins FROM (SELECT unnest(['small_fixed', 'medium_overlap', 'hierarchical']) AS c) LEFT JOIN b ON b.condition = c GROUP BY c""",
    "box_statistics": f"""WITH {_GRADED}, q AS (SELECT condition, quantile_cont(overall, [0.25, 0.5, 0.75]) AS q FROM o WHERE overall IS NOT NULL GROUP BY condition)
        SELECT condition, round(min(overall) FILTER (overall BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])), 6) AS low, round(any_value(q[1]), 6) AS q1, round(any_value(q[2]), 6) AS median, round(any_value(q[3]), 6) AS q3,
               round(max(overall) FILTER (overall BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])), 6) AS high FROM o JOIN q USING (condition) WHERE overall IS NOT NULL GROUP BY condition""",
    "unpivot_metrics": f"WITH {_GRADED} " + " UNION ALL ".join(f"SELECT window_id, condition, '{m}' AS metric, {m}::DOUBLE AS value FROM g" for m in METRICS),
    "duplicate_ids": "SELECT md5(coalesce(text, '')) AS chunk_id, count(*) AS times FROM documents GROUP BY 1 HAVING count(*) > 1",
    "orphan_children": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "embedding_report": """SELECT label AS embedding_partition, count(*) AS rows, min(len(embedding))::INT AS min_size, max(len(embedding))::INT AS max_size,
        arg_min(vec_id, vec_id)::VARCHAR AS first_id, arg_max(vec_id, vec_id)::VARCHAR AS last_id FROM embeddings GROUP BY label""",
}
# the same windows, made over rows
ORACLES |= {"row_chunks_small": ORACLES["chunk_small_fixed"], "row_chunks_overlap": ORACLES["chunk_medium_overlap"]}
