"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.centroid_clustering import clusters_digest
from loomwork.llm.document_fingerprints import edited_fingerprints
from loomwork.llm.exact_dedup import exact_dedup_digest
from loomwork.llm.language_id import language_digest
from loomwork.llm.line_dedup import line_dedup_digest
from loomwork.llm.packing import ByteBpe, load_byte_bpe, packing_digest
from loomwork.llm.permutation_index import nearest_digest
from loomwork.llm.sentencepiece_codec import load_pieces, sentencepiece_digest
from loomwork.llm.simhash import simhash_components
from loomwork.llm.source_divergence import source_divergence
from loomwork.llm.substring_dedup import substring_dedup_digest
from loomwork.llm.toxicity import toxicity_digest
from loomwork.llm.url_filter import filter_urls
from loomwork.sources.readers import spread

#: The rules that op10 judges by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, over all cores even if it lies in one row group."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(documents(spark, sf_dir))


def byte_bpe(path: str | None = None) -> ByteBpe:
    """The byte-level BPE of op4 and the pipeline; ``path`` may name another file of its kind."""
    return load_byte_bpe(path or public_tokenizers.path("byte_bpe_50k.json"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_digest(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(documents(spark, sf_dir), byte_bpe())


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digest(documents(spark, sf_dir), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digest(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_digest(documents(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_digest(table(spark, sf_dir, "embeddings"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_permutation_index": op3_permutation_index,
    "op4_packing": op4_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_source_divergence": op13_source_divergence,
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def _clusters_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """Every vector against every centroid, round after round."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({size} * x::DOUBLE)::BIGINT) AS v FROM embeddings
             WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        parts.append(f"a{r} AS (SELECT n, min(struct_pack(d := {apart}, c := x.c)) AS m FROM v, c{r} x GROUP BY n)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT a.m.c AS c, i, sum(v.v[i])::HUGEINT AS s, count(*) AS k FROM a{r} a JOIN v ON a.n = v.n, generate_series(1, {size}) g(i) GROUP BY 1, 2)")
            parts.append(f"m{r} AS (SELECT c, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT x.c, coalesce(m.v, x.v) AS v FROM c{r} x LEFT JOIN m{r} m ON x.c = m.c)")
    return f"""
        WITH {", ".join(parts)}
        SELECT v.vec_id, a.m.c::INT AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
               (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(x.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v ON a.n = v.n JOIN c{rounds} x ON a.m.c = x.c"""


ORACLES = {
    "op11_centroid_clustering": _clusters_sql(),
    "op12_document_fingerprints": r"""
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS n, count(*) OVER () AS total, doc_id, coalesce(text, '') AS text FROM documents),
        e AS (SELECT d.n, x.n AS after, d.doc_id, length(d.text) AS n_chars, d.text,
                     left(d.text, length(d.text) - length(d.text) // 2) || left(x.text, length(d.text) // 2) AS edited
              FROM d JOIN d x ON x.n = d.n % d.total + 1),
        t AS (SELECT n, 'own' AS kind, text FROM e UNION ALL SELECT n, 'edited', edited FROM e),
        p AS (SELECT n, kind, unnest(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS part FROM t),
        h AS (SELECT n, kind, floor(sqrt(length(part)))::BIGINT AS weight, sha256(part) AS h FROM p WHERE part <> ''),
        g AS (SELECT unnest(generate_series(0, 127)) AS lane),
        s AS (SELECT n, kind, lane, sum(weight * (1 - 2 * ((('0x' || substr(h, 1 + lane // 4, 1))::INT >> (3 - lane % 4)) & 1)))::BIGINT AS v FROM h, g GROUP BY ALL),
        w AS (SELECT n, kind, sum(('0x' || substr(h, 33, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS w0, sum(('0x' || substr(h, 49, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS w1 FROM h GROUP BY ALL),
        f AS (SELECT t.n, t.kind, list(coalesce(v, 0) ORDER BY g.lane) AS signs,
                     string_agg(lpad(lower(to_hex(((coalesce(v, 0) % 65536 + 65536) % 65536)::BIGINT)), 4, '0'), '' ORDER BY g.lane)
                     || lpad(lower(to_hex(coalesce(any_value(w0), 0)::UBIGINT)), 16, '0') || lpad(lower(to_hex(coalesce(any_value(w1), 0)::UBIGINT)), 16, '0') AS digits
              FROM t CROSS JOIN g LEFT JOIN s ON s.n = t.n AND s.kind = t.kind AND s.lane = g.lane LEFT JOIN w ON w.n = t.n AND w.kind = t.kind GROUP BY t.n, t.kind),
        q AS (SELECT e.n, e.doc_id, e.n_chars, e.edited, o.digits AS own, x.digits AS changed,
                     list_sum(list_transform(o.signs, lambda v: v * v)) AS a, list_sum(list_transform(x.signs, lambda v: v * v)) AS b, list_sum(list_transform(y.signs, lambda v: v * v)) AS c,
                     list_sum(list_transform(list_zip(o.signs, x.signs), lambda v: (v[1] - v[2]) * (v[1] - v[2]))) AS ab,
                     list_sum(list_transform(list_zip(o.signs, y.signs), lambda v: (v[1] - v[2]) * (v[1] - v[2]))) AS ac
              FROM e JOIN f o ON o.n = e.n AND o.kind = 'own' JOIN f x ON x.n = e.n AND x.kind = 'edited' JOIN f y ON y.n = e.after AND y.kind = 'own')
        SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, own AS fingerprint, changed AS edited_fingerprint,
               CASE WHEN a + b = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - ab::DOUBLE / (a + b)::DOUBLE) END AS near_edited,
               CASE WHEN a + c = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - ac::DOUBLE / (a + c)::DOUBLE) END AS near_next
        FROM q""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY lang),
        g AS (SELECT d.lang, d.source, any_value(v) AS v, any_value(v.total) AS whole FROM d LEFT JOIN v ON d.lang = v.lang GROUP BY ALL),
        t AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * g.v) AS p,
                     1 + (1000000000::HUGEINT * (kept.whole + 5)) // (g.whole + 5 * g.v) AS q
              FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
              LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM
              (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q))
        SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        w AS (SELECT doc_id, unnest(generate_series(1, len(lines) - 2)) AS p, lines FROM l WHERE len(lines) >= 3),
        s AS (SELECT doc_id, p, lines[p : p + 2] AS win FROM w),
        r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS n FROM s),
        c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE n > 1),
        e AS (SELECT doc_id, unnest(generate_series(1, len(lines))) AS p, unnest(lines) AS line FROM l),
        k AS (SELECT e.doc_id, count(*) AS n_lines, count(c.p) AS n_removed,
                     string_agg(line, chr(10) ORDER BY e.p) FILTER (c.p IS NULL) AS kept
              FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        w AS (SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS p, words FROM d WHERE len(words) >= 20),
        r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(words[p : p + 19], ' ') ORDER BY doc_id, p) AS n FROM w),
        c AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS p FROM r WHERE n > 1),
        e AS (SELECT doc_id, unnest(generate_series(1, len(words))) AS p, unnest(words) AS word FROM d),
        k AS (SELECT e.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (c.p IS NULL) AS kept
              FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op10_url_filter": rf"""
        WITH r(h, p, v) AS (VALUES {_RULE_ROWS}),
        a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT row_number() OVER () AS n, page_id,
                     translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
        SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path,
               arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
        FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY n""",
}
