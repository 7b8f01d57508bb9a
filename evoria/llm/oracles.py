"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_BIN = "CASE WHEN v < 64 THEN v ELSE v - v % (1::BIGINT << (length(bin(v)) - 7)) END"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, lang, source, coalesce(text, '') AS body, {_WORDS} AS w FROM documents),
windows AS (SELECT row_no, unnest(range(1, len(w) - 1)) AS i, w FROM d),
shingle AS (SELECT row_no, i, list_aggregate(w[i:i+2], 'string_agg', ' ') AS t FROM windows),
dup AS (SELECT row_no, i FROM shingle QUALIFY count(*) OVER (PARTITION BY row_no, t) > 1),
covered AS (SELECT row_no, count(*) AS n_repeat_words FROM (SELECT DISTINCT row_no, unnest([i, i + 1, i + 2]) FROM dup) GROUP BY row_no),
lines AS (SELECT row_no, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
f AS (
  SELECT d.row_no, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, len(ln)::BIGINT AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (row_no) LEFT JOIN covered USING (row_no)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {{'word_length': (word_chars * 100) // greatest(n_words, 1), 'symbols': (n_symbols * 1000) // greatest(word_chars, 1),
      'dup_lines': (n_dup_lines * 1000) // greatest(n_lines, 1), 'repeats': (n_repeat_words * 1000) // greatest(n_words, 1)}} AS m FROM f),
long AS (
  SELECT lang, source, 'word_length' AS metric, m.word_length AS v FROM g WHERE NOT base_failed UNION ALL SELECT lang, source, 'symbols', m.symbols FROM g WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_lines', m.dup_lines FROM g WHERE NOT base_failed UNION ALL SELECT lang, source, 'repeats', m.repeats FROM g WHERE NOT base_failed),
bins AS (SELECT lang, source, metric, {_BIN} AS bin FROM long),
q AS (SELECT quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.5) AS q50, quantile_disc(bin, 0.75) AS q75, quantile_disc(bin, 0.9) AS q90, lang, source, metric, GROUPING(lang, source) AS level, count(*) AS total FROM bins
  GROUP BY GROUPING SETS ((lang, source, metric), (lang, metric), (metric))),
w AS (SELECT lang, source, metric, level, total, q75 + 6 * (q75 - q25) AS body, q90 + 6 * (q90 - q50) AS tail FROM q),
fence AS (
  SELECT o.lang, o.source, o.metric, greatest(CASE WHEN o.total >= 50 THEN o.body WHEN l.total >= 50 THEN l.body ELSE a.body END,
    least(CASE WHEN o.total >= 50 THEN o.tail END, CASE WHEN l.total >= 50 THEN l.tail END, a.tail)) AS top
  FROM w o JOIN w l ON o.level = 0 AND l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN w a ON a.level = 3 AND a.metric = o.metric),
tops AS (SELECT lang, source, max(top) FILTER (metric = 'word_length')::DOUBLE AS t1, max(top) FILTER (metric = 'symbols')::DOUBLE AS t2, max(top) FILTER (metric = 'dup_lines')::DOUBLE AS t3, max(top) FILTER (metric = 'repeats')::DOUBLE AS t4 FROM fence GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(
    (word_chars * 100.0::DOUBLE <= t1 * n_words OR (word_chars * 100.0::DOUBLE - t1 * n_words) ** 2 <= 9 * (word_chars * 100.0::DOUBLE) * 100) AND
    (n_symbols * 1000.0::DOUBLE <= t2 * word_chars OR (n_symbols * 1000.0::DOUBLE - t2 * word_chars) ** 2 <= 9 * (n_symbols * 1000.0::DOUBLE) * 1000) AND
    (n_dup_lines * 1000.0::DOUBLE <= t3 * n_lines OR (n_dup_lines * 1000.0::DOUBLE - t3 * n_lines) ** 2 <= 9 * (n_dup_lines * 1000.0::DOUBLE) * 1000) AND
    (n_repeat_words * 1000.0::DOUBLE <= t4 * n_words OR (n_repeat_words * 1000.0::DOUBLE - t4 * n_words) ** 2 <= 9 * (n_repeat_words * 1000.0::DOUBLE) * 1000), true) AS kept
FROM g LEFT JOIN tops ON g.lang IS NOT DISTINCT FROM tops.lang AND g.source IS NOT DISTINCT FROM tops.source
"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.x) = len(d.x))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha1(body)) AS most FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), 'string_agg', '') AS bits FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN most IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN most IS DISTINCT FROM page_id THEN most END AS refers_to
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": QUALITY, "op4_exact_top_k": TOP_K, "op9_warc": WARC}
