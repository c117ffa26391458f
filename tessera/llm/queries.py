"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (content_sort, cross_align, embedding_dedup, fertility, language_mix, ngram_join, packing, piece_bpe, preference, pseudo_likelihood, quality, secret_scan, turn_repair,
               warc, word_tokens)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.identify(_read(spark, sf_dir, "documents"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.train_and_score(_read(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(_read(spark, sf_dir, "documents"), tokenizer_path(piece_bpe.MODEL))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(word_tokens.MODEL))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.stale_pairs(_read(spark, sf_dir, "conversations")))


def fertility_paths() -> tuple[str, str]:
    return tokenizer_path(fertility.PIECES), tokenizer_path(fertility.BYTES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_read(spark, sf_dir, "documents"), fertility_paths())


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(_read(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(_read(spark, sf_dir, "conversations"))


def op13_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.align(_read(spark, sf_dir, "documents"), tokenizer_path(cross_align.A_MODEL), tokenizer_path(cross_align.B_MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_warc, op3_language, op4_pseudo_likelihood, op5_pieces, op6_packing, op7_embedding_dedup,
                            op8_preference, op9_quality, op10_secrets, op11_content_sort,
                            op12_turn_repair, op13_cross_align)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
         JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n
         HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n""",
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda j: list_aggregate(list_transform([15, 10, 5, 0], lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * j + 1)::INT, 5))::INT >> k) & 31) + 1, 1)),
        'string_agg', '')), 'string_agg', '') AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM q""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x), c AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.y, v.vec_id)) AS component_id,
       least(v.vec_id, coalesce(c.y, v.vec_id)) = v.vec_id AS kept FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN c ON c.x = v.vec_id""",
    "op8_preference": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY conv_id) AS last FROM c),
s AS (SELECT *, max(CASE WHEN role = 'assistant' AND i < last THEN i END) OVER (PARTITION BY conv_id) AS stale FROM r),
t AS (SELECT conv_id, any_value(last) AS last, any_value(stale) AS stale,
        coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i < last), '') AS p,
        any_value(text) FILTER (WHERE i = last) AS good, any_value(text) FILTER (WHERE i = stale) AS bad FROM s GROUP BY conv_id),
u AS (SELECT *, '<|assistant|>' || chr(10) AS h, '<|end|>' || chr(10) AS z, good = bad AS same FROM t WHERE stale IS NOT NULL)
SELECT conv_id AS pair_id, (CASE WHEN same THEN last ELSE last - 1 END)::BIGINT AS prompt_turns,
       CASE WHEN same THEN p || h || good || z ELSE p END AS prompt,
       CASE WHEN same THEN '' ELSE h || good || z END AS chosen,
       CASE WHEN same OR good = '' THEN '' ELSE '14:' || (14 + length(good)) END AS chosen_mask,
       CASE WHEN same THEN '' ELSE h || bad || z END AS rejected,
       CASE WHEN same OR bad = '' THEN '' ELSE '14:' || (14 + length(bad)) END AS rejected_mask FROM u""",
    "op11_content_sort": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)""",
    "op12_turn_repair": r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
k AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::UBIGINT)) AS b
        FROM conversations),
h AS (SELECT k.*, xor(list_reduce(b, lambda c, x: xor(t[(1 + (xor(c, x) & 255))::BIGINT], c >> 8)), 4294967295::UBIGINT) % 20 AS hit FROM k, tab),
d AS (SELECT g, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
        CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
        lag(c) OVER (PARTITION BY g ORDER BY i) || c AS pair FROM o),
e AS (SELECT *, CASE fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS more FROM f),
-- The best (cost, audit, text) of each state after i rows: 0 nothing yet, 1 after s, 2 after u, 3 after a.
p(g, i, v0, v1, v2, v3) AS (
    SELECT DISTINCT g, 0::BIGINT, {'n': 0::BIGINT, 'a': '', 'x': ''}, {'n': 1000000000::BIGINT, 'a': '', 'x': ''}, {'n': 3::BIGINT, 'a': 'I', 'x': 'user:'},
           {'n': 6::BIGINT, 'a': 'II', 'x': 'user:' || chr(10) || 'assistant:'} FROM k
    UNION ALL
    SELECT g, i, v0, v1, u2, list_min([v3, {'n': u2.n + 3, 'a': u2.a || 'I', 'x': u2.x || chr(10) || 'assistant:'}]) FROM (
        SELECT g, i, v0, v1, v3, list_min([v2, {'n': v0.n + 3, 'a': v0.a || 'I', 'x': v0.x || CASE WHEN v0.x = '' THEN '' ELSE chr(10) END || 'user:'}, {'n': v1.n + 3, 'a': v1.a || 'I', 'x': v1.x || CASE WHEN v1.x = '' THEN '' ELSE chr(10) END || 'user:'},
                                           {'n': v3.n + 3, 'a': v3.a || 'I', 'x': v3.x || CASE WHEN v3.x = '' THEN '' ELSE chr(10) END || 'user:'}]) AS u2 FROM (
            SELECT p.g, e.i, {'n': v0.n + 4, 'a': v0.a || 'D', 'x': v0.x} AS v0,
                list_min([{'n': v1.n + 4, 'a': v1.a || 'D', 'x': v1.x}, {'n': v0.n + more + CASE WHEN c = 's' THEN 0 ELSE 1000000000 END, 'a': v0.a || 'K', 'x': v0.x || CASE WHEN v0.x = '' THEN '' ELSE chr(10) END || line}]) AS v1,
                list_min([{'n': v2.n + 4, 'a': v2.a || 'D', 'x': v2.x}]
                    || list_transform([v0, v1, v3], lambda v: {'n': v.n + more + CASE WHEN c = 'u' THEN 0 ELSE 1000000000 END, 'a': v.a || 'K', 'x': v.x || CASE WHEN v.x = '' THEN '' ELSE chr(10) END || line})
                    || list_transform([v0, v1, v3], lambda v: {'n': v.n + more + 3, 'a': v.a || 'R', 'x': v.x || CASE WHEN v.x = '' THEN '' ELSE chr(10) END || 'user:' || text})) AS v2,
                list_min([{'n': v3.n + 4, 'a': v3.a || 'D', 'x': v3.x}, {'n': v2.n + more + CASE WHEN c = 'a' THEN 0 ELSE 1000000000 END, 'a': v2.a || 'K', 'x': v2.x || CASE WHEN v2.x = '' THEN '' ELSE chr(10) END || line},
                          {'n': v2.n + more + 3, 'a': v2.a || 'R', 'x': v2.x || CASE WHEN v2.x = '' THEN '' ELSE chr(10) END || 'assistant:' || text}]) AS v3
            FROM p JOIN (SELECT *, role || ':' || text AS line FROM e) AS e ON e.g = p.g AND e.i = p.i + 1))),
z AS (SELECT g, arg_max(list_min([v0, v3]), i) AS v FROM p GROUP BY g),
s AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       v.n AS cost, v.a AS audit, sha256(v.x) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, g FROM k) LEFT JOIN s USING (g) LEFT JOIN z USING (g)""",
}
