"""I01, T, D: ids, text and time scalars on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text, times, urls
from ..operators import extract
from .registry import query, table

_NS = ids.NAMESPACE.hex
_UUID = f"""substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%x', (('0x' || substr(h, 17, 1))::INTEGER & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query("I01_det_uuid5", f"WITH x AS (SELECT doc_id, sha1(unhex('{_NS}') || encode('doc' || chr(31) || source || chr(31) || doc_id::VARCHAR)) AS h FROM documents) SELECT doc_id, {_UUID} AS id FROM x")
def det_uuid5(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.uuid5("doc", F.col("source"), F.col("doc_id").cast("string")).alias("id"))


_WIDE = "ＡＢ１ ⅳ ﬁn ㎏ "


@query("T01_token_counts", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN 'AB1 iv fin kg ' ELSE '' END || text), '[a-z0-9]+') AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS n, len(list_distinct(w))::INTEGER AS n_distinct, w[1] AS first FROM t""")
def token_counts(spark, d):
    said = F.concat(F.when(F.col("doc_id") % 3 == 0, _WIDE).otherwise(""), F.col("text"))
    t = table(spark, d, "documents").select("doc_id", text.tokenize(said).alias("w"))
    return t.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct"), F.get("w", F.lit(0)).alias("first"))


_MORE_QUERY = "CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Token=YWJj==&n=a%20b+c&%75tm_term=1&blank=&flag&p=100%25*~'"


@query("T02_url_normalize", rf"""WITH v AS (SELECT page_id, regexp_extract(url, '^([^#]*)', 1) || {_MORE_QUERY} || regexp_extract(url, '(#.*)$', 1) AS url FROM pages),
u AS (SELECT page_id, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS s, regexp_extract(trim(url), '^[^:/?#]+://([^/?#]*)', 1) AS h, regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(trim(url), '\?([^#]*)', 1) AS q FROM v),
k AS (SELECT *, list_aggregate(list_transform(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: contains(x, '=')),
  lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(x, instr(x, '=') + 1), '+', ' '))}}),
  lambda x: x.v <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','spm','from','share_token','chksm','scene','pos','shareid','src','sid','tt_from','group_id'], lower(x.k))),
  lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), 'string_agg', '&') AS kept FROM u)
SELECT page_id, CASE WHEN s = '' THEN 'https' ELSE lower(s) END || '://' || lower(h) || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/+$', '') END || CASE WHEN kept IS NULL OR kept = '' THEN '' ELSE '?' || kept END AS url FROM k""")
def url_normalize(spark, d):
    said = F.expr(rf"regexp_extract(url, '^([^#]*)', 1) || {_MORE_QUERY} || regexp_extract(url, '(#.*)$', 1)")
    return table(spark, d, "pages").select("page_id", urls.normalize_url(said).alias("url"))


_BODY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"""


@query("T03_body_normalize", f"SELECT doc_id, sha256({_BODY}) AS h, length({_BODY})::INTEGER AS n FROM documents")
def body_normalize(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.normalize_body(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("h"), F.length("t").alias("n"))


@query("T04_lineage_groups", f"SELECT substr(sha256(substr({_BODY}, 1, 2000)), 1, 16) AS g, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def lineage_groups(spark, d):
    return table(spark, d, "documents").groupBy(text.lineage_key(text.normalize_body(F.col("text"))).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("T05_quote_locate", r"""WITH n AS (SELECT doc_id, replace(regexp_replace(text, '[\p{Cf}\p{Zs}\x{00}-\x{09}\x{0b}-\x{1f}\x{7f}-\x{9f}]', '', 'g'), chr(10), ' ') AS t FROM documents), b AS (SELECT item_id, replace(regexp_replace(substr(text, 1, 60), '[\p{Cf}\p{Zs}\x{00}-\x{09}\x{0b}-\x{1f}\x{7f}-\x{9f}]', '', 'g'), chr(10), ' ') AS q FROM benchmark)
SELECT item_id, doc_id, (instr(regexp_replace(t, ' +', ' ', 'g'), q) - 1)::INTEGER AS s, (instr(regexp_replace(t, ' +', ' ', 'g'), q) - 1 + length(q))::INTEGER AS e FROM n, b WHERE length(q) >= 6 AND contains(regexp_replace(t, ' +', ' ', 'g'), q)""")
def quote_locate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    quotes = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 60).alias("q"))
    found = extract.find_quotes(docs, quotes, "doc_id", "text", "item_id", "q")
    return found.select("item_id", "doc_id", F.col("span.start").alias("s"), F.col("span.end").alias("e"))


_CUTS = " ".join(f"WHEN strpos(reverse(c), {s}) > 0 AND 800 - strpos(reverse(c), {s}) > 400 THEN substr(c, 1, 801 - strpos(reverse(c), {s}))" for s in ("'。'", "'！'", "'？'", "'；'", "'.'", "'!'", "'?'", "chr(10)"))


@query("T06_sentence_truncate", f"WITH x AS (SELECT doc_id, text, substr(text, 1, 800) AS c FROM documents) SELECT doc_id, CASE WHEN length(text) <= 800 THEN text {_CUTS} ELSE c END AS t FROM x")
def sentence_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentence_cut(F.col("text")).alias("t"))


@query("T08_chunk_fixed", "WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1200)) AS s, text FROM documents) SELECT doc_id, s::INTEGER AS start, sha256(substr(text, s + 1, 1200)) AS h FROM c WHERE length(substr(text, s + 1, 1200)) >= 50")
def chunk_fixed(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(text.fixed_chunks(F.col("text"))).alias("x"))
    return c.filter(F.length("x.body") >= 50).select("doc_id", "x.start", F.sha2(F.col("x.body").cast("binary"), 256).alias("h"))


@query("T09_chunk_overlapping", "WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1050)) AS s, text FROM documents) SELECT doc_id, count(*) AS n, sum(length(substr(text, s + 1, 1100)))::BIGINT AS total FROM c GROUP BY 1")
def chunk_overlapping(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(text.fixed_chunks(F.col("text"), 1100, 1050)).alias("x"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x.body")).alias("total"))


@query("T10_best_snippet", """WITH q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 220, 1), 60)) AS s FROM documents), h AS (SELECT doc_id, text, s, len(list_filter((SELECT w FROM q), lambda t: contains(substr(text, s + 1, 220), t))) AS hits FROM c),
b AS (SELECT doc_id, text, arg_min(s, -hits * 1000000 + s) AS s FROM h GROUP BY ALL), r AS (SELECT doc_id, replace(substr(text, s + 1, 220), chr(10), ' ') AS t FROM b) SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS snippet FROM r""")
def best_snippet(spark, d):
    b = table(spark, d, "benchmark")
    # one query text: a single row
    q = b.groupBy().agg(F.min_by("text", "item_id").alias("q")).select(F.array_distinct(text.tokenize(F.col("q"))).alias("tokens"))
    return table(spark, d, "documents").join(F.broadcast(q)).select("doc_id", text.best_snippet(F.col("text"), F.col("tokens")).alias("snippet"))


@query("T11_entity_key", r"""SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(lower(s_name || ' Co-Ltd (Inc)'), '[\s·•・''’()（）【】\[\]-]+', '', 'g'), '^(.{2,})inc$', '\1'), '^(.{2,}?)(ltd|co)+$', '\1') AS k FROM supplier""")
def entity_key(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.entity_key(F.concat("s_name", F.lit(" Co-Ltd (Inc)"))).alias("k"))


@query("T12_entity_type", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'company' WHEN c_mktsegment = 'FURNITURE' THEN 'person' ELSE 'other' END AS t FROM customer")
def entity_type(spark, d):
    name = F.concat("c_name", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), " Corp").when(F.col("c_mktsegment") == "FURNITURE", "总裁").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", text.entity_type(name).alias("t"))


_KINDS, _MAP = ("click", "purchase", "other"), {"view": "click", "buy": "purchase"}


@query("T13_event_type_map", """SELECT event_id, CASE WHEN event_type IN ('click', 'purchase', 'other') THEN event_type WHEN event_type = 'view' THEN 'click' WHEN contains(event_type, 'view') THEN 'click' WHEN contains(event_type, 'buy') THEN 'purchase' WHEN contains(event_type, 'click') THEN 'click' WHEN contains(event_type, 'purchase') THEN 'purchase' ELSE 'other' END AS kind, event_type AS raw FROM events""")
def event_type_map(spark, d):
    return table(spark, d, "events").select("event_id", text.event_type(F.col("event_type"), _KINDS, _MAP).alias("kind"), F.col("event_type").alias("raw"))


@query("T14_frame_text", "SELECT event_id, '类型:' || event_type || ' 阶段:unknown 主体:' || 'u' || user_id || '、x 对象:未知 动作:' || event_type || ' 范围:k=' || (props->>'k') || ' 时间:' || strftime(ts, '%Y-%m-%d') || '~?' AS frame FROM events")
def frame_text(spark, d):
    e = table(spark, d, "events")
    scope = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    out = text.frame_text(F.col("event_type"), F.lit(None).cast("string"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("x")), F.array().cast("array<string>"), F.col("event_type"), scope, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(None).cast("string"))
    return e.select("event_id", out.alias("frame"))


@query("T15_judge_frame", "SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN ' [' || p_type || ']' ELSE '' END || ' (' || p_size || ') 证据“' || p_brand || '；' || p_type || '”' AS frame FROM part")
def judge_frame(spark, d):
    kind = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("")
    return table(spark, d, "part").select("p_partkey", text.judge_frame(F.col("p_name"), kind, F.col("p_size").cast("string"), F.array("p_brand", F.lit(""), "p_type")).alias("frame"))


@query("T17_canonical_json", """SELECT c_custkey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS j FROM customer""")
def canonical_json(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.canonical_map(F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name")).alias("j"))


@query("T18_values_equal", "SELECT p_partkey, p_size = 10 AS same, p_brand = 'Brand#11' AS same_brand FROM part")
def values_equal(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.values_equal(F.concat(F.col("p_size").cast("string"), F.lit(",000.0元")), F.lit("10000")).alias("same"), text.values_equal(F.col("p_brand"), F.lit("Brand#11")).alias("same_brand"))


@query("T20_loose_key", r"SELECT doc_id, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS k FROM documents")
def loose_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.loose_key(F.col("text")).cast("binary"), 256).alias("k"))


_RULES = [("STEEL|TIN", "metal"), ("BRASS|COPPER|NICKEL", "alloy")]


@query("T21_first_and_only_rule", """SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'metal' WHEN regexp_matches(p_type, 'BRASS|COPPER|NICKEL') THEN 'alloy' END AS first, CASE WHEN p_size <= 40 THEN CASE WHEN regexp_matches(p_type, 'STEEL|TIN') AND NOT regexp_matches(p_type, 'BRASS|COPPER|NICKEL') THEN 'metal' WHEN regexp_matches(p_type, 'BRASS|COPPER|NICKEL') AND NOT regexp_matches(p_type, 'STEEL|TIN') THEN 'alloy' END END AS only FROM part""")
def first_and_only_rule(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", text.first_rule(t, _RULES).alias("first"), F.when(F.col("p_size") <= 40, text.only_rule(t, _RULES)).alias("only"))


@query("T22_length_filters", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 60 AND 4000 AND NOT regexp_matches(text, '[A-Z]{5,}')")
def length_filters(spark, d):
    return table(spark, d, "documents").filter(F.length("text").between(60, 4000) & ~F.col("text").rlike("[A-Z]{5,}")).select("doc_id")


@query("T23_query_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00' AS day, strftime(o_orderdate, '%Y-%m') || '-15 12:00:00' AS month FROM orders")
def query_date(spark, d):
    o = table(spark, d, "orders")
    shown = lambda c: F.date_format(times.query_date(c), "yyyy-MM-dd HH:mm:ss")
    return o.select("o_orderkey", shown(F.concat(F.lit("what about "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit("?"))).alias("day"), shown(F.concat(F.date_format("o_orderdate", "yyyy年M月"), F.lit("的情况"))).alias("month"))


@query("T24_query_intent", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'as_of' WHEN 1 THEN 'evolution' WHEN 2 THEN 'current' ELSE 'exploration' END AS intent FROM documents")
def query_intent(spark, d):
    words = F.array(F.lit("当时已知什么"), F.lit("价格变化历程"), F.lit("目前情况"), F.lit("tell me more"))
    return table(spark, d, "documents").select("doc_id", text.intent(F.get(words, (F.col("doc_id") % 4).cast("int"))).alias("intent"))


@query("T25_relative_window", "SELECT o_orderkey, strftime(o_orderdate::DATE - to_years(2), '%Y-%m-%d') AS y, strftime(o_orderdate::DATE - to_months(6), '%Y-%m-%d') AS m FROM orders")
def relative_window(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", times.relative_window(F.lit("近两年"), at).cast("string").alias("y"), times.relative_window(F.lit("过去六个月"), at).cast("string").alias("m"))


@query("D01_parse_time", """SELECT o_orderkey, strftime(CASE o_orderkey % 8 WHEN 3 THEN date_trunc('month', o_orderdate) WHEN 4 THEN date_trunc('year', o_orderdate) WHEN 0 THEN o_orderdate WHEN 5 THEN o_orderdate + INTERVAL 8 HOUR WHEN 6 THEN o_orderdate + INTERVAL 13 HOUR WHEN 7 THEN o_orderdate + INTERVAL 8 HOUR ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS at, ['second', 'day', 'day', 'month', 'year', 'second', 'second', 'second'][o_orderkey % 8 + 1] AS precision FROM orders""")
def parse_time(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at).cast("string")
    said = F.get(F.array(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy.M.d"), F.concat(F.lit("on "), F.date_format(at, "yyyy年M月d日"), F.lit("（周一）")), F.date_format(at, "yyyy年M月"), F.date_format(at, "yyyy"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'-0500'"), epoch), (F.col("o_orderkey") % 8).cast("int"))
    t = table(spark, d, "orders").select("o_orderkey", times.parse_time(said).alias("x"))
    return t.select("o_orderkey", F.date_format("x.at", "yyyy-MM-dd HH:mm:ss").alias("at"), "x.precision")


@query("D02_time_range", """SELECT o_orderkey, strftime(o_orderdate + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 1 SECOND WHEN 1 THEN INTERVAL 1 DAY WHEN 2 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END, '%Y-%m-%d %H:%M:%S') AS upper FROM orders""")
def time_range(spark, d):
    precision = F.get(F.array(*(F.lit(p) for p in ("second", "day", "month", "year"))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(times.time_range(F.col("o_orderdate").cast("timestamp"), precision)["upper"], "yyyy-MM-dd HH:mm:ss").alias("upper"))


@query("D03_clamp_year", "SELECT count(*) AS n, count(CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1999 THEN 1 END) AS kept FROM orders")
def clamp_year(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count(times.clamp_year(F.col("o_orderdate"), 1996, 1999)).alias("kept"))


@query("D04_event_time", """WITH w AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderdate + to_years(CASE o_orderkey % 5 WHEN 0 THEN 198 ELSE 24 END) AS t FROM orders),
x AS (SELECT o_orderkey, k, t::DATE AS a, (t + to_days((o_orderkey % 7 - 3)::INTEGER))::DATE AS b FROM w),
y AS (SELECT o_orderkey, k, a, b, CASE WHEN year(a) BETWEEN 2015 AND 2027 THEN a END AS ca, CASE WHEN year(b) BETWEEN 2015 AND 2027 THEN b END AS cb FROM x)
SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN cb IS NULL THEN ca WHEN ca IS NOT NULL THEN least(ca, cb) END WHEN 1 THEN ca WHEN 3 THEN ca END::VARCHAR AS lower,
  CASE k WHEN 0 THEN CASE WHEN ca IS NULL THEN cb WHEN cb IS NOT NULL THEN greatest(ca, cb) END WHEN 2 THEN cb + 1 WHEN 3 THEN ca + 1 END::VARCHAR AS upper,
  CASE WHEN CASE k WHEN 0 THEN coalesce(ca, cb) WHEN 2 THEN cb ELSE ca END IS NULL THEN 'unknown' ELSE 'day' END AS precision FROM y""")
def event_time(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.expr("to_date(add_months(o_orderdate, 12 * CASE WHEN o_orderkey % 5 = 0 THEN 198 ELSE 24 END))"))
    a, b, k = F.date_format("t", "yyyy-MM-dd"), F.date_format(F.date_add("t", (F.col("o_orderkey") % 7 - 3).cast("int")), "yyyy-MM-dd"), F.col("o_orderkey") % 4
    x = times.event_time(F.when(k.isin(0, 1), a), F.when(k.isin(0, 2), b), F.when(k == 3, a), F.lit("unknown"))
    t = o.select("o_orderkey", x.alias("x"))
    return t.select("o_orderkey", F.date_format("x.lower", "yyyy-MM-dd").alias("lower"), F.date_format("x.upper", "yyyy-MM-dd").alias("upper"), "x.precision")


@query("D06_day_gap", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_shipdate > o_orderdate + INTERVAL 3 DAY THEN floor((epoch(l_shipdate) - epoch(o_orderdate) - 259200) / 86400) WHEN o_orderdate > l_shipdate THEN floor((epoch(o_orderdate) - epoch(l_shipdate)) / 86400) ELSE 0 END)::BIGINT AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def day_gap(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    lo, ship = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    gap = times.day_gap(lo, lo + F.expr("INTERVAL 3 DAY"), ship, ship)
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", gap.cast("long").alias("gap"))


@query("D07_time_decay", "SELECT event_id, round(CASE WHEN user_id % 5 = 0 THEN 0.6 WHEN ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-20' THEN 1.0 ELSE exp(-abs(floor((epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts)) / 86400000000.0)) / 180.0) END, 6) AS boost FROM events")
def time_decay(spark, d):
    at = F.when(F.col("user_id") % 5 != 0, F.col("ts").cast("timestamp"))
    stamp = lambda s: F.lit(s).cast("timestamp")
    return table(spark, d, "events").select("event_id", F.round(times.decay(at, stamp("2024-01-15"), stamp("2024-01-20")), 6).alias("boost"))


@query("D08_month_truncation", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_truncation(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
