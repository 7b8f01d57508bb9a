"""S, M and window extensions: sources, sinks, queues and streams on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import graph
from ..sources import files, scorers
from ..streaming import streams
from .facts import _DECIDED
from .registry import query, table
from .text import _NS, _UUID


def _folder(spark, name):
    return f"{graph.shared_folder(spark)}/evoria/{name}-{uuid.uuid4().hex}"


@query("S01_corpus_json_scan", "SELECT doc_id::VARCHAR AS title, length(text)::INTEGER AS n FROM documents")
def corpus_json(spark, d):
    path = _folder(spark, "corpus")
    item = F.struct(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"))
    files.write_corpus(table(spark, d, "documents"), path, "source", "doc_id", item)
    items, _ = files.read_corpus(spark, [path])
    return items.select("title", F.length("content").alias("n"))


@query("S03_clean_layer_manifest", "SELECT source AS company, lang AS month, count(*) AS n FROM documents GROUP BY ALL")
def clean_layer_manifest(spark, d):
    return files.write_clean(table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("company"), F.col("lang").alias("month")), _folder(spark, "clean"))


@query("S05_content_addressed_objects", "SELECT sha256(text) AS hash, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS path, octet_length(encode(any_value(text)))::INTEGER AS bytes FROM documents GROUP BY text")
def objects(spark, d):
    return files.put_objects(table(spark, d, "documents"), "text").select("hash", "path", "bytes")


@query("S06_jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl(spark, d):
    path = _folder(spark, "jsonl")
    files.write_jsonl(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("S07_review_csv", "SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 10 <> 0 THEN 1 END AS human, CASE WHEN (SELECT avg((doc_id % 10 <> 0)::INT) FROM documents) >= 0.8 THEN 'human' ELSE 'partial' END AS standing FROM documents")
def review_csv(spark, d):
    path = _folder(spark, "review")
    files.write_review(table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 != 0, 1).alias("human")), path)
    rows, standing = files.read_review(spark, path, "doc_id long, text string, human int", "human")
    return rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), "human", F.lit(standing).alias("standing"))


@query("S08_corpus_fingerprint", "SELECT sha256(string_agg(doc_id || ':' || substr(sha256(text), 1, 16), chr(10) ORDER BY doc_id || ':' || substr(sha256(text), 1, 16))) AS fingerprint FROM documents")
def corpus_fingerprint(spark, d):
    return files.corpus_fingerprint(table(spark, d, "documents"), "doc_id", "text")


_SHOWN = "concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")) + ")"


@query("S09_table_fingerprint", f"WITH r AS (SELECT sha256({_SHOWN}) AS h FROM orders) SELECT count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS low, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS high FROM r")
def table_fingerprint(spark, d):
    return files.table_fingerprint(table(spark, d, "orders"), ["o_totalprice"])


@query("S10_scored_pairs", "SELECT a.item_id AS a, b.item_id AS b, CASE WHEN a.item_id % 2 = 0 THEN 0.25 ELSE round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) END AS p FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[^ \\n]+')) AS x FROM benchmark) a JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[^ \\n]+')) AS y FROM benchmark) b ON b.item_id = a.item_id + 1")
def scored_pairs(spark, d):
    t = table(spark, d, "benchmark")
    pairs = t.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(t.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("tb")), "a")
    cache = scorers.cache_key(pairs.filter("a % 2 = 0"), "ta", "tb", "words").select("cache_key", F.lit(0.25).alias("p"))
    return scorers.score(pairs, "ta", "tb", "words", cache, scorers.jaccard_judge).select("a", "b", F.round("p", 6).alias("p"))


# a chunk ends after the last mark of its second half, and the next one starts ``overlap`` before its end
_LAST_MARK = "(length(seg) - least(CASE WHEN strpos(reverse(seg), '。') > 0 THEN strpos(reverse(seg), '。') ELSE length(seg) + 1 END, CASE WHEN strpos(reverse(seg), chr(10)) > 0 THEN strpos(reverse(seg), chr(10)) ELSE length(seg) + 1 END) + 1)"


@query("T07_chunk_overlap_counts", f"""WITH RECURSIVE c AS (
  SELECT doc_id, -1 AS chunk_no, 0 AS first, 500 AS last, length(text) AS size FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, chunk_no + 1, first, CASE WHEN until < size AND {_LAST_MARK} > 0 THEN first + 1500 + {_LAST_MARK} ELSE until END, size FROM (
    SELECT c.doc_id, c.chunk_no, c.last - 500 AS first, least(c.last + 2500, c.size) AS until, c.size, substr(d.text, c.last - 500 + 1501, least(c.last + 2500, c.size) - (c.last - 500) - 1500) AS seg
    FROM c JOIN documents d USING (doc_id) WHERE c.last < c.size OR c.chunk_no = -1))
SELECT doc_id, chunk_no, (last - first)::INTEGER AS n FROM c WHERE chunk_no >= 0""")
def chunk_overlap(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(udfs.chunks_column(F.col("text"))).alias("chunk_no", "body"))
    return c.select("doc_id", "chunk_no", F.length("body").alias("n"))


@query("T16_json_repair", """SELECT event_id, '{"k":' || (props->>'k') || ',"t":["' || event_type || '"]}' AS j FROM events""")
def json_repair(spark, d):
    udfs.register(spark)
    broken = F.concat(F.lit('<think>x</think>```json\n{"t": ["'), "event_type", F.lit('",], "k": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, ', "half": "abc').otherwise(",}\n```"))
    return table(spark, d, "events").select("event_id", F.regexp_replace(F.call_function("evoria_repair_json", broken), '"half":"abc",', "").alias("j"))


@query("M01_enqueue", f"WITH x AS (SELECT DISTINCT event_type AS topic, user_id::VARCHAR AS payload FROM events), y AS (SELECT *, sha1(unhex('{_NS}') || encode('msg' || chr(31) || topic || chr(31) || payload)) AS h FROM x) SELECT topic, payload, {_UUID} AS message_id FROM y")
def enqueue(spark, d):
    return streams.enqueue(table(spark, d, "events"), F.col("event_type"), F.col("user_id").cast("string"), F.lit(0)).select("topic", "payload", "message_id")


@query("M02_claim", "WITH q AS (SELECT o_orderpriority AS topic, o_orderkey::VARCHAR AS message_id, epoch(o_orderdate)::BIGINT AS available_at FROM orders WHERE o_orderstatus = 'O') SELECT topic, message_id, 1 AS attempts FROM q QUALIFY row_number() OVER (PARTITION BY topic ORDER BY available_at, message_id) <= 3")
def claim(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").cast("string").alias("message_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("available_at"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.lit(0).alias("attempts"))
    return streams.claim(q, F.lit(1 << 40), 3).select("topic", "message_id", "attempts")


@query("M03_stream_retry_dead_letter", "SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 3 THEN 'dead' ELSE 'pending' END AS status, CASE WHEN count(*) >= 3 THEN 0 ELSE (1 << count(*))::BIGINT END AS delay FROM events WHERE value < 5 GROUP BY 1")
def retry_dead_letter(spark, d):
    failed = streams.table_stream(spark, d, "events").filter("value < 5").select("user_id")
    return streams.drain(streams.retries(failed, "user_id"), "update")


@query("M04_recover_running", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status FROM orders")
def recover_running(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return streams.recover(table(spark, d, "orders").select("o_orderkey", s.alias("status")))


@query("M05_stream_outbox_projection", "SELECT user_id, event_type, max(event_id) AS version FROM events GROUP BY ALL")
def outbox_projection(spark, d):
    s = streams.table_stream(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("version"))
    return streams.project(s, ["user_id", "event_type"], "version")


@query("M06_cache_watermark", "SELECT (sum(n * 1000) + count(*))::BIGINT AS watermark FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def cache_watermark(spark, d):
    v = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("version"))
    return streams.watermark_key(v, "user_id", "version")


@query("M07_stream_slot_state", f"WITH {_DECIDED} SELECT event_id, decision FROM dd")
def slot_state(spark, d):
    s = streams.table_stream(spark, d, "events")
    f = s.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("slot"), F.floor(F.col("value") / 25).cast("string").alias("value"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string").alias("lineage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.unix_micros(F.col("ts").cast("timestamp")).alias("sys_time"), F.lit(False).alias("correction"))
    return streams.drain(streams.slot_decisions(f, "slot", "event_id"), "update").select("event_id", "decision")


@query("X10_stream_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    s = streams.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drain(streams.counted(s, "ts", "1 day", F.window("ts", "1 day"), ["event_type"]), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("X11_sliding_window", "WITH w AS (SELECT date_trunc('day', ts) - to_days(i::INTEGER) AS s FROM events, range(0, 3) t(i)) SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM w GROUP BY 1")
def sliding_window(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "3 days", "1 day", "0 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "n")


@query("X12_session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session_window(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query("X13_stream_dedupe_watermark", "SELECT event_id FROM events")
def stream_dedupe(spark, d):
    s = streams.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.drain(twice.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))
