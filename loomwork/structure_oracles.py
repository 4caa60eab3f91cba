"""DuckDB SQL for the queries of pages, paragraphs, sections, units, reports and checks."""

from __future__ import annotations

from loomwork.functions.text import BOILERPLATE
from loomwork.operators.cleaning import CLOSE_UP
from loomwork.operators.scoring import METRICS
from loomwork.oracles import _GRADED, _TITLE, _UPPER, SMALL, UNITS, WORD, fold, tfidf, tokens, top, words

STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
CONDITIONS = "['small_fixed', 'medium_overlap', 'hierarchical']"

#: Words of placed pages: file, page, line_no, block_no, y0, y1, word_no, token, x0, x1, within the margins and without blanks.
PLACED = """
    p0 AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    p1 AS (SELECT file, i, CASE WHEN i % 9 = 4 THEN '=== PAGE ' || i || ' ===' ELSE raw END AS line FROM p0),
    p2 AS (SELECT file, (i // 12 + 1)::INT AS page, (i % 12)::INT AS line_no, (i % 12 // 2)::INT AS block_no, (30 + 86 * (i % 12))::DOUBLE AS y0, (30 + 86 * (i % 12) + 10 + i % 3 * 5)::DOUBLE AS y1,
                  unnest(string_split(line, ' ')) AS raw_token, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_no FROM p1),
    pw AS (SELECT *, (50 + word_no * 7)::DOUBLE AS x0, (56 + word_no * 7)::DOUBLE AS x1, regexp_replace(raw_token, '^\\s+|\\s+$', '', 'g') AS token FROM p2
           WHERE y1 >= 50 AND y0 <= 970)"""


def boilerplate(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{p}')" for p in BOILERPLATE) + ")"


def clean_line(x: str) -> str:
    for a, b in (*CLOSE_UP[:8], (" ’ ", "’"), (" '' ", "''"), (" - ", "-")):
        x = f"replace({x}, '{a}', '{b}')"
    return STRIP(f"regexp_replace({x}, '\\s+', ' ', 'g')")


LINES = f"""{PLACED},
    pl0 AS (SELECT file, page, block_no, line_no, min(y0) AS min_y, max(y1) AS max_y, min(x0) AS min_x, max(x1) AS max_x, string_agg(token, ' ' ORDER BY word_no, x0, token) AS raw FROM pw WHERE token <> '' GROUP BY ALL),
    pl1 AS (SELECT *, {clean_line("raw")} AS text FROM pl0),
    pl AS (SELECT *, max_y - min_y AS height FROM pl1 WHERE text <> '' AND NOT {boilerplate("text")})"""


def heading(x: str) -> str:
    return f"({words(x)} BETWEEN 1 AND 14 AND length({x}) <= 120 AND (starts_with({x}, 'CHAPTER ') OR (NOT regexp_matches({x}, '[.!?]$') AND ({_UPPER(x)} > 0.60 OR {_TITLE(x)}))))"


def normalized(x: str) -> str:
    return STRIP(f"regexp_replace(regexp_replace(replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


PARAGRAPHS_OF_PAGES = f"""{LINES},
    q0 AS (SELECT *, regexp_matches(text, '^(?i:=+\\s*page\\s+\\d+\\s*=+)$') AS marker, row_number() OVER (PARTITION BY file, page ORDER BY round_even(min_y, 1), round_even(min_x, 1), block_no, line_no) AS o FROM pl),
    q1 AS (SELECT *, sum(marker::INT) OVER (PARTITION BY file, page ORDER BY o) AS markers, coalesce(median(CASE WHEN height > 0 THEN height END) OVER (PARTITION BY file, page), 10.0) * 1.35 AS gap FROM q0),
    q2 AS (SELECT *, lag(text) OVER w AS pt, lag(block_no) OVER w AS pb, lag(max_y) OVER w AS py, lag(markers) OVER w AS pm FROM q1 WHERE NOT marker WINDOW w AS (PARTITION BY file, page ORDER BY o)),
    q3 AS (SELECT *, {heading("text")} AS h, coalesce({heading("pt")}, false) AS ph, regexp_matches(text, '^[A-Z“"(\\[]') OR {heading("text")} AS fresh, regexp_matches(pt, '[.!?”"]$') AS ended, min_y - py > gap AS large FROM q2),
    q4 AS (SELECT *, sum((pt IS NULL OR markers <> pm OR h OR ph OR (block_no <> pb AND (large OR (ended AND fresh))) OR (large AND ended AND fresh))::INT) OVER (PARTITION BY file, page ORDER BY o) AS island FROM q3),
    q5 AS (SELECT file, page, island, {normalized("string_agg(text, ' ' ORDER BY o)")} AS text FROM q4 GROUP BY ALL),
    q AS (SELECT file, page, (row_number() OVER (PARTITION BY file, page ORDER BY island) - 1)::INT AS paragraph_no, text FROM q5 WHERE text <> '' AND NOT {boilerplate("text")})"""

SHAPES = "'‘’“”–—' || chr(160) || chr(173), '''''\"\"-- '"


def blocks(source: str) -> str:
    """``b`` (id, n, block) of ``source`` (id, text): blank lines bound blocks, those over 300 words are split."""
    line = "array_to_string(list_transform(string_split(x0, chr(10)), lambda l: regexp_replace(l, '\\s+$', '')), chr(10))"
    norm = "array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10))"
    for pattern in (r"^\|\s*\d+\s+", r"^\d+\s*\n", r"^_+\s*$"):
        norm = f"regexp_replace({norm}, '{pattern}', '')"
    marked = r"""regexp_replace(regexp_replace(flat, '\s+(\d+\.\s+)', chr(10) || chr(10) || '\1', 'g'),
        '([.?!])\s+((?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,5}|[A-Z]{2,}(?:\s+[A-Z]{2,}){0,5}))\s+', '\1' || chr(10) || chr(10) || '\2 ', 'g')"""
    split = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {STRIP('s')}), lambda s: s <> '')"
    return rf"""
    b0 AS (SELECT id, regexp_replace(translate(text, {SHAPES}), '\r\n?', chr(10), 'g') AS x0 FROM {source}),
    b1 AS (SELECT id, {STRIP(f"regexp_replace({line}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS x1 FROM b0),
    b2 AS (SELECT id, unnest(regexp_split_to_array(x1, '\n\s*\n')) AS raw, generate_subscripts(regexp_split_to_array(x1, '\n\s*\n'), 1) AS i FROM b1),
    b3 AS (SELECT id, i, {STRIP(f"regexp_replace({norm}, '[ \t]{{2,}}', ' ', 'g')")} AS block FROM b2),
    b4 AS (SELECT id, i, block, {STRIP("regexp_replace(block, '\\s+', ' ', 'g')")} AS flat FROM b3 WHERE block <> ''),
    b5 AS (SELECT id, i, list_filter(list_transform(regexp_split_to_array({marked}, '\n\s*\n'), lambda p: {STRIP("p")}), lambda p: p <> '') AS parts FROM b4 WHERE {words("block")} > 300),
    b6 AS (SELECT id, i, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM b5),
    b7 AS (SELECT id, i, j, unnest({split("part")}) AS s, generate_subscripts({split("part")}, 1) - 1 AS m FROM b6 WHERE {words("part")} > 300),
    b8 AS (SELECT *, {words("s")} AS w FROM b7),
    b9 AS (SELECT id, i, j, m, w AS cur, 0 AS k FROM b8 WHERE m = 0
           UNION ALL SELECT x.id, x.i, x.j, x.m, CASE WHEN cur + x.w > 140 THEN x.w ELSE cur + x.w END, CASE WHEN cur + x.w > 140 THEN k + 1 ELSE k END
           FROM b9 JOIN b8 x ON x.id = b9.id AND x.i = b9.i AND x.j = b9.j AND x.m = b9.m + 1),
    b10 AS (SELECT id, i, j, k, string_agg(s, ' ' ORDER BY m) AS piece FROM b9 JOIN b8 USING (id, i, j, m) GROUP BY ALL
            UNION ALL SELECT id, i, j, 0, part FROM b6 WHERE {words("part")} <= 300),
    b11 AS (SELECT *, sum(CASE WHEN r > 1 AND {words("piece")} < 80 THEN 0 ELSE 1 END) OVER (PARTITION BY id, i ORDER BY j, k) AS g FROM (SELECT *, row_number() OVER (PARTITION BY id, i ORDER BY j, k) AS r FROM b10)),
    b12 AS (SELECT id, i, g, string_agg(piece, ' ' ORDER BY j, k) AS block FROM b11 GROUP BY ALL UNION ALL SELECT id, i, 0, block FROM b4 WHERE {words("block")} <= 300),
    b AS (SELECT id, block, (row_number() OVER (PARTITION BY id ORDER BY i, g) - 1)::INT AS n FROM b12)"""


_SAYS = rf"(regexp_matches(block, '[.!?]$') OR ({words('block')} >= 10 AND len(list_filter(regexp_extract_all(block, '{WORD}'), lambda w: regexp_matches(w, '\p{{Ll}}') AND NOT regexp_matches(w, '[\p{{Lu}}\p{{Lt}}]'))) >= 5))"
_HEADER = f"({words('block')} BETWEEN 1 AND 14 AND length(block) <= 100 AND NOT {_SAYS} AND NOT regexp_matches(block, '[.!?;]$') AND ({_UPPER('block')} > 0.60 OR {_TITLE('block')} OR (regexp_full_match(block, '[A-Z\\s\\-:&]+') AND {words('block')} <= 12)))"


def paragraphs(source: str) -> str:
    """``d`` (id, n, block, words, text, header, blk, stop, kind, a, size) of ``source`` (id, text)."""
    noise = f"(len(list_filter(regexp_split_to_array(regexp_replace(header, '\\s+', ' ', 'g'), ' '), lambda x: length(x) <= 3 AND regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}'))) >= 2 AND {_UPPER('header')} > 0.5)"
    kind = f"""CASE WHEN {STRIP('text')} = '' THEN 'empty' WHEN header <> '' AND {words('header')} <= 12 THEN 'headed_body' WHEN regexp_full_match({STRIP('text')}, '[-*•].+') THEN 'list_item'
        WHEN regexp_matches({STRIP('text')}, '^\\d+\\.') THEN 'numbered_item' WHEN length(text) - length(replace(text, '?', '')) >= 2 AND {words('text')} < 120 THEN 'exercise_or_prompt' ELSE 'body' END"""
    return f"""{blocks(source)},
    d0 AS (SELECT *, {_HEADER} AS h, {words('block')} >= 20 AS long FROM b),
    d1 AS (SELECT *, h AND coalesce(lead(long) OVER w, false) AS heads, lead(block) OVER w AS body FROM d0 WINDOW w AS (PARTITION BY id ORDER BY n)),
    d2 AS (SELECT *, coalesce(lag(heads) OVER (PARTITION BY id ORDER BY n), false) AS taken FROM d1),
    d3 AS (SELECT id, n AS blk, (n + heads::INT)::INT AS stop, CASE WHEN heads THEN block || chr(10) || chr(10) || body ELSE block END AS text, CASE WHEN heads THEN block END AS header FROM d2 WHERE NOT taken),
    d AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY blk) - 1)::INT AS n, {words('text')}::INT AS w, {kind} AS kind, coalesce({noise}, false) AS noisy, length(text)::INT AS size,
                 coalesce(sum(length(text) + 2) OVER (PARTITION BY id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS a FROM d3)"""


def segments(source: str) -> str:
    """``s`` (id, n, j, parts, text, start, stop, whole) of ``source`` (id, n, text, a, z): paragraphs over 420 tokens as groups of sentences."""
    flat = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    split = f"list_filter(string_split(regexp_replace({flat}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
    return f"""
    s0 AS (SELECT id, n, text, {split} AS ss FROM {source} WHERE {STRIP('text')} <> '' AND {tokens(words('text'))} > 420),
    s1 AS (SELECT id, n, unnest(ss) AS x, generate_subscripts(ss, 1) - 1 AS m FROM s0 WHERE len(ss) > 1),
    s2 AS (SELECT *, {words('x')} AS w FROM s1),
    s3 AS (SELECT id, n, m, w AS cur, 0 AS k FROM s2 WHERE m = 0
           UNION ALL SELECT y.id, y.n, y.m, CASE WHEN {tokens('(cur + y.w)')} > 180 THEN y.w ELSE cur + y.w END, CASE WHEN {tokens('(cur + y.w)')} > 180 THEN k + 1 ELSE k END FROM s3 JOIN s2 y ON y.id = s3.id AND y.n = s3.n AND y.m = s3.m + 1),
    s4 AS (SELECT id, n, k, string_agg(x, ' ' ORDER BY m) AS piece FROM s3 JOIN s2 USING (id, n, m) GROUP BY ALL),
    s5 AS (SELECT *, sum(CASE WHEN k > 0 AND {tokens(words('piece'))} < 80 THEN 0 ELSE 1 END) OVER (PARTITION BY id, n ORDER BY k) - 1 AS j FROM s4),
    s6 AS (SELECT id, n, j::INT AS j, string_agg(piece, ' ' ORDER BY k) AS piece FROM s5 GROUP BY ALL),
    s7 AS (SELECT s6.id, s6.n, j, piece, text, CASE WHEN instr(text, piece) > 0 THEN instr(text, piece) - 1 ELSE 0 END AS start, CASE WHEN instr(text, piece) > 0 THEN instr(text, piece) - 1 ELSE 0 END + length(piece) AS next
           FROM s6 JOIN s0 ON s6.id = s0.id AND s6.n = s0.n WHERE j = 0
           UNION ALL SELECT y.id, y.n, y.j, y.piece, s7.text, CASE WHEN instr(substr(s7.text, s7.next + 1), y.piece) > 0 THEN s7.next + instr(substr(s7.text, s7.next + 1), y.piece) - 1 ELSE s7.next END,
                 CASE WHEN instr(substr(s7.text, s7.next + 1), y.piece) > 0 THEN s7.next + instr(substr(s7.text, s7.next + 1), y.piece) - 1 ELSE s7.next END + length(y.piece) FROM s7 JOIN s6 y ON y.id = s7.id AND y.n = s7.n AND y.j = s7.j + 1),
    s AS (SELECT s7.id, s7.n, j, (max(j) OVER (PARTITION BY s7.id, s7.n) + 1)::INT AS parts, piece AS text, (a + start)::INT AS start, (a + start + length(piece))::INT AS stop FROM s7 JOIN {source} o ON o.id = s7.id AND o.n = s7.n
          UNION ALL SELECT id, n, 0, 1, {STRIP('text')}, a::INT, z::INT FROM {source} o WHERE {STRIP('text')} <> '' AND NOT EXISTS (SELECT 1 FROM s6 WHERE s6.id = o.id AND s6.n = o.n))"""


_HEADED = """f AS (SELECT 'doc' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || CASE WHEN doc_id % 2 = 0 THEN 'One Of Many' ELSE 'The Other Half' END || chr(10) || chr(10) ELSE '' END
              || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents)"""
#: Units of whole documents, each a file of one block at first: as UNITS, with the paragraph's number in p.
STRUCTURED = f"""f AS (SELECT 'doc' || doc_id AS id, coalesce(text, '') AS text FROM documents), {paragraphs('f')}, o AS (SELECT id, n, text, a, a + size AS z FROM d), {segments('o')},
    u AS (SELECT id AS d, (row_number() OVER (PARTITION BY id ORDER BY start, stop, n, j) - 1)::INT AS n, text AS line, {tokens(words('text'))} AS t, start AS a, stop - start AS size FROM s)"""

_CHUNKS = f"""{SMALL}, y0 AS (SELECT d, k, count(*)::INT AS n_units, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text FROM x GROUP BY d, k),
    y AS (SELECT *, d || '::small_fixed::' || d || '::' || lpad(k::VARCHAR, 5, '0') AS id, {tokens(words('text'))} AS t FROM y0)"""

ORACLES = {
    "json_lines_scan": f"{_CHUNKS} SELECT id AS chunk_id, lag(id) OVER (PARTITION BY d ORDER BY k) AS prev_chunk_id, t AS token_count_est, n_units, md5(text) AS text_md5 FROM y",
    "observed_manifest": f"{_CHUNKS} SELECT d AS source_doc_id, count(*) AS rows, sum(t)::BIGINT AS tokens, (sum(count(*)) OVER ())::BIGINT AS all_rows, (sum(sum(t)) OVER ())::BIGINT AS all_tokens FROM y GROUP BY d",
    "json_rows_scan": f"{_CHUNKS} SELECT id AS chunk_id, t AS token_count_est, n_units, md5(text) AS text_md5 FROM y",
    "vignette_scan": f"SELECT 'V' || conv_id AS vignette_id, 'v' || conv_id || '__w1' AS slug, md5(string_agg({STRIP('role')} || ': ' || {STRIP('text')}, chr(10) ORDER BY turn, role, text)) AS query_md5 FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id",
    "sheet_scan": """SELECT 'q' || item_id AS source_file, 'a,b' AS response_preview, md5('"' || text || '",' || chr(10) || '"x"') AS query_md5, '' AS reviewer FROM benchmark""",
    "text_scan": """WITH b AS (SELECT 'book=book_' || doc_id % 7 AS doc_id, string_agg(text, chr(10) ORDER BY documents.doc_id, text) || chr(10) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1)
        SELECT doc_id, 0 AS source_file_index, length(text)::INT AS chars, md5(text) AS text_md5 FROM b""",
    "partition_scan": f"""{_CHUNKS} SELECT id AS chunk_id, k AS embedding_row, 'hierarchical_child' AS retrieval_setting, 64 AS size, CASE WHEN len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) > 0 THEN 'unit' ELSE 'zero' END AS norm FROM y""",
    "saved_index_search": f"""{SMALL}, docs AS (SELECT d || '::small_fixed::' || d || '::' || lpad(k::VARCHAR, 5, '0') AS id, (d, k) AS place, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text FROM x GROUP BY d, k),
        {tfidf('i', 'docs')}, {top('i', 'docs', 2, 'place')} SELECT q AS query_id, rank::INT AS rank, id AS chunk_id, string_split(id, '::')[1] AS source_doc_id FROM i_r""",
    "page_lines": f"WITH {LINES} SELECT file, page, block_no, line_no, min_x, max_x, min_y, max_y, height, md5(text) AS text_md5 FROM pl",
    "page_paragraphs": f"WITH {PARAGRAPHS_OF_PAGES} SELECT file, page, paragraph_no, md5(text) AS text_md5 FROM q",
    "extracted_texts": f"""WITH {PARAGRAPHS_OF_PAGES}, t AS (SELECT file, page, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_no) AS text FROM q GROUP BY ALL),
        e AS (SELECT file, string_agg('=== PAGE ' || page || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text FROM t GROUP BY file) SELECT file, length(text)::INT AS chars, md5(text) AS text_md5 FROM e""",
    "block_texts": f"""WITH {PLACED}, k AS (SELECT file, page, line_no, min(y0) AS y0, {STRIP("string_agg(raw_token, ' ' ORDER BY word_no)")} AS text FROM pw GROUP BY ALL)
        SELECT file, page, md5(string_agg(text, chr(10) || chr(10) ORDER BY y0)) AS text_md5 FROM k WHERE text <> '' GROUP BY ALL""",
    "document_blocks": f"WITH RECURSIVE f AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {blocks('f')} SELECT id AS doc_id, n, {words('block')}::INT AS words, md5(block) AS block_md5 FROM b",
    "document_paragraphs": f"""WITH RECURSIVE {_HEADED}, {paragraphs('f')} SELECT id AS doc_id, n AS paragraph_id, blk AS source_block_start, stop AS source_block_end, header IS NOT NULL AS has_attached_header, noisy AS header_is_noisy,
        kind AS paragraph_type, w AS word_count, a AS char_start_in_doc, a + size AS char_end_in_doc, md5(text) AS text_md5 FROM d""",
    "section_nodes": rf"""
        WITH r AS (SELECT doc_id AS k, 'book' || doc_id % 7 AS book, CASE doc_id % 5 WHEN 0 THEN 'ch' || doc_id || '_sec' || doc_id % 4 || 'a' WHEN 1 THEN 'ch1_ch' || doc_id || '_the-inner-parts' || doc_id WHEN 2 THEN 'intro_note-' || doc_id
                          WHEN 3 THEN 'pt2_sec' || doc_id || '_what they_need' ELSE 'odd' || doc_id END AS rest, coalesce(text, '') AS text FROM documents),
        f AS (SELECT *, k % 11 = 0 AS other, CASE WHEN k % 11 = 0 THEN 'other' ELSE book END || '_' || rest AS stem FROM r),
        t AS (SELECT *, string_split(CASE WHEN starts_with(stem, book || '_') THEN rest ELSE stem END, '_') AS tok FROM f),
        c AS (SELECT *, upper(list_filter(tok, lambda x: regexp_full_match(x, 'ch\d+[a-zA-Z]*'))[-1]) AS ch, upper(list_filter(tok, lambda x: regexp_full_match(x, 'sec\d+[a-zA-Z]*'))[-1]) AS sec,
                     upper(list_filter(tok, lambda x: regexp_full_match(x, 'pt\d+[a-zA-Z]*'))[-1]) AS pt, array_to_string(list_filter(tok, lambda x: NOT regexp_full_match(x, '(ch|sec|pt)\d+[a-zA-Z]*')), ' ') AS others FROM t),
        title AS (SELECT *, list_transform(list_transform(tok, lambda x: translate(x, '-_', '  ')), lambda x: x) AS plain FROM c),
        p AS (SELECT *, CASE WHEN lower(tok[1]) IN ('intro', 'introduction', 'preface', 'foreword', 'prologue', 'epilogue') THEN 'Intro > Note ' || k
                     ELSE array_to_string(list_filter([ch, sec, pt, CASE WHEN others <> '' THEN array_to_string(list_transform(string_split(translate(others, '-_', '  '), ' '), lambda x: upper(x[1]) || lower(substr(x, 2))), ' ') END], lambda x: x IS NOT NULL), ' > ') END AS path FROM title),
        l AS (SELECT book, k, stem, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
        m AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY k, i) - 1 AS id FROM l WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
        g AS (SELECT book, k, count(*) AS n, min(id) AS a, max(id + length(line)) AS z FROM m GROUP BY ALL)
        SELECT p.book AS doc_id, p.book || '::' || stem || '::node' AS node_id, ch AS chapter_label, sec AS section_label, pt AS part_label, path AS section_path_str, coalesce(n, 0)::INT AS n_paragraphs, a::INT AS first_paragraph, a::INT AS char_start_in_doc, z::INT AS char_end_in_doc
        FROM p LEFT JOIN g ON p.book = g.book AND p.k = g.k""",
    "natural_files": "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS place FROM documents",
    "document_units": f"""WITH RECURSIVE o AS (SELECT doc_id::VARCHAR AS id, 0 AS n, text, 100 AS a, length(text) + 100 AS z FROM documents WHERE text IS NOT NULL), {segments('o')}
        SELECT id || '::p00000::u' || lpad(j::VARCHAR, 2, '0') AS unit_id, parts AS split_count_within_paragraph, {words('text')}::INT AS word_count, {tokens(words('text'))} AS token_count_est, start AS char_start_in_doc, stop AS char_end_in_doc, md5(text) AS text_md5 FROM s""",
    "structured_corpus": f"""WITH RECURSIVE {STRUCTURED},
        p AS (SELECT d, n, t, sum(t) OVER (PARTITION BY d ORDER BY n) AS upto, count(*) OVER (PARTITION BY d) AS total FROM u),
        e AS (SELECT s.d, s.n AS s, any_value(s.total) AS total, 1 + max(x.n) FILTER (x.n = s.n OR x.upto - s.upto + s.t <= 900 OR x.upto - x.t - s.upto + s.t < 300) AS stop FROM p s JOIN p x ON s.d = x.d AND x.n >= s.n GROUP BY s.d, s.n),
        bk AS (SELECT q.d, q.n + 1 AS stop, min(x.n) AS back FROM p q JOIN p x ON q.d = x.d AND x.n <= q.n WHERE x.n = q.n OR q.upto - x.upto + x.t <= 180 GROUP BY q.d, q.n),
        nx AS (SELECT e.d, e.s, e.stop, e.total, CASE WHEN bk.back > e.s THEN bk.back ELSE greatest(e.s + 1, e.stop - 1) END AS next FROM e JOIN bk ON e.d = bk.d AND e.stop = bk.stop),
        h AS (SELECT d, s, stop, total, next, 0 AS k FROM nx WHERE s = 0 UNION ALL SELECT nx.d, nx.s, nx.stop, nx.total, nx.next, h.k + 1 FROM h JOIN nx ON nx.d = h.d AND nx.s = h.next WHERE h.stop < h.total),
        {fold(350, 120)}, {fold(300, 120, 'c2')},
        m AS (SELECT 'small_fixed' AS r, d, k, n FROM c UNION ALL SELECT 'hierarchical_child', d, k, n FROM c2 UNION ALL SELECT 'hierarchical_parent', d, 0, n FROM u UNION ALL SELECT 'medium_overlap', h.d, h.k, u.n FROM h JOIN u ON u.d = h.d AND u.n >= h.s AND u.n < h.stop),
        y AS (SELECT r, d, k, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text, min(a) AS a, max(a + size) AS z FROM m JOIN u USING (d, n) GROUP BY r, d, k)
        SELECT d || '::' || replace(r, 'hierarchical', 'hier') || '::ch1::' || lpad(k::VARCHAR, 5, '0') AS chunk_id, r AS retrieval_setting, CASE WHEN r = 'hierarchical_child' THEN d || '::hier_parent::ch1::00000' END AS parent_id,
               {tokens(words('text'))} AS token_count_est, a::INT AS char_start_in_doc, z::INT AS char_end_in_doc, md5(text) AS text_md5 FROM y""",
    "chunk_manifest": f"""WITH RECURSIVE {UNITS}, {fold(350, 120)}, m AS (SELECT 'small_fixed' AS r, d, k, n FROM c UNION ALL SELECT 'hierarchical_parent', d, 0, n FROM u),
        y AS (SELECT r, d, {tokens("sum(" + words("line") + ")")} AS t FROM m JOIN u USING (d, n) GROUP BY r, d, k)
        SELECT r AS retrieval_setting, d AS source_doc_id, count(*) AS rows, sum(t)::BIGINT AS tokens FROM y GROUP BY ALL""",
    "compared_conditions": f"""WITH {UNITS}, par AS (SELECT 'doc' || doc_id AS id, coalesce(text, '') AS text FROM documents), kid AS (SELECT d || '::p' || lpad(n::VARCHAR, 5, '0') || '::u00' AS id, d, n, (d, n) AS place, line AS text FROM u),
        {tfidf('a', 'par')}, {top('a', 'par', 3)}, {tfidf('b', 'kid')}, {top('b', 'kid', 3, 'place')},
        m AS (SELECT a_r.q, kid.id, kid.d, kid.n, coalesce(b_s.score, 0) AS score FROM a_r JOIN kid ON kid.d = a_r.id LEFT JOIN b_s ON b_s.q = a_r.q AND b_s.id = kid.id),
        z AS (SELECT *, row_number() OVER (PARTITION BY q, d ORDER BY score DESC, n) AS r1 FROM m QUALIFY r1 <= 2),
        y AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d, n) AS rank FROM z QUALIFY rank <= 5),
        hp AS (SELECT q, string_agg(id || '::hierarchical_parent', ' ' ORDER BY rank) AS parent_hits FROM a_r GROUP BY q), hc AS (SELECT q, string_agg(id, ' ' ORDER BY rank) AS hits FROM y GROUP BY q)
        SELECT q AS query_id, 'small_fixed' AS condition, string_agg(id || '::small_fixed', ' ' ORDER BY rank) AS hits, '' AS parent_hits FROM a_r GROUP BY q
        UNION ALL SELECT q, 'medium_overlap', string_agg(id, ' ' ORDER BY rank), '' FROM b_r GROUP BY q
        UNION ALL SELECT hp.q, 'hierarchical', coalesce(hits, ''), parent_hits FROM hp LEFT JOIN hc ON hp.q = hc.q""",
    "vignette_windows": f"""WITH t AS (SELECT *, min(turn) OVER p AS first, max(turn) OVER p AS last FROM conversations WINDOW p AS (PARTITION BY conv_id)),
        h AS (SELECT *, CASE WHEN turn <= (first + last) // 2 THEN 1 ELSE 2 END AS half FROM t)
        SELECT 'V' || conv_id AS vignette_id, 'W' || half AS window_id, 'v' || conv_id || '__w' || half AS slug, md5(string_agg({STRIP('role')} || ': ' || {STRIP('text')}, chr(10) ORDER BY turn, role, text)) AS query_md5
        FROM h WHERE {STRIP("coalesce(text, '')")} <> '' GROUP BY conv_id, half""",
    "metric_heatmap": f"WITH {_GRADED}, x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, condition, {m}::DOUBLE AS v FROM g" for m in METRICS) + ") SELECT metric, " + ", ".join(f"round(avg(v) FILTER (condition = '{c}'), 6) AS {c}" for c in ("small_fixed", "medium_overlap", "hierarchical")) + " FROM x GROUP BY metric",
    "radar_points": f"WITH {_GRADED} " + " UNION ALL ".join(f"SELECT condition, '{m}' AS metric, round({n} * 2 * pi() / {len(METRICS)}, 6) AS angle, round(avg({m}), 2) AS value FROM g GROUP BY condition" for n, m in enumerate(METRICS)),
    "known_metrics": f"WITH {_GRADED} SELECT condition, count(*) AS n FROM g WHERE grounding_score IS NOT NULL GROUP BY condition",
    "row_gaps": """WITH e AS (SELECT vec_id, label, vec_id::INT AS row, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS expected_row FROM embeddings) SELECT * FROM e WHERE row IS DISTINCT FROM expected_row""",
    "empty_texts": "SELECT conv_id, turn FROM conversations WHERE text IS NULL OR trim(text) = ''",
    "prepared_passages": "SELECT item_id, md5('passage: ' || text) AS with_prefix, md5(text) AS without FROM benchmark",
    "validation_slugs": "SELECT item_id, CASE WHEN s = '' THEN 'retrieval_validation' ELSE s END AS slug FROM (SELECT item_id, regexp_replace(regexp_replace(lower(substr(text, 1, 80)), '[^\\p{L}\\p{N}]', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM benchmark)",
}
# the same rows, from files that a manifest names
ORACLES["manifest_scan"] = ORACLES["json_lines_scan"]
ORACLES["text_tree_scan"] = """WITH x AS (SELECT *, 'Book_' || doc_id % 13 AS b, CASE WHEN doc_id % 2 = 0 THEN 'words' ELSE 'blocks' END AS m FROM documents WHERE doc_id IS NOT NULL),
    y AS (SELECT *, b || CASE WHEN doc_id % 5 > 0 THEN '/part' ELSE '' END || '/doc' || doc_id || '.pdf' AS r FROM x)
    SELECT 'doc' || doc_id || '.txt' AS file, 'source_book: ' || b AS book, 'relative_path: ' || r AS relative, 'extraction_mode: ' || m AS mode,
        md5(concat_ws(chr(10), '=== SOURCE METADATA ===', 'source_book: ' || b, 'source_file: doc' || doc_id || '.pdf', 'relative_path: ' || r, 'extraction_mode: ' || m,
            'top_margin_ratio: 0.05', 'bottom_margin_ratio: 0.03', '=== BEGIN EXTRACTED TEXT ===', coalesce(text, ''), '')) AS md5 FROM y"""
ORACLES["streamed_summary"] = """WITH s AS (SELECT conv_id, role AS condition, turn, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    v AS (SELECT *, CASE WHEN n % 3 > 0 THEN n % 5 + 1 END AS a, CASE WHEN n % 4 > 0 THEN (n + 1) % 5 + 1 END AS g FROM s),
    l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, a DESC NULLS LAST, g DESC NULLS LAST, condition DESC NULLS LAST) = 1)
    SELECT condition, count(*) AS total_outputs, count(a + g) AS scored_outputs, round(avg(a) FILTER (g IS NOT NULL), 3) AS mean_ifs_adherence, round(avg(g) FILTER (a IS NOT NULL), 3) AS mean_grounding FROM l GROUP BY condition"""
