"""A, Q: bitemporal facts and the query layer on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bitemporal, evidence
from .registry import query, table

_SLOT = "user_id || ':' || event_type || ':' AS slot"
_FACTS = f"f AS (SELECT event_id, {_SLOT}, event_type, floor(value / 25)::BIGINT AS v, ((props->>'k')::BIGINT % 3) AS lineage, ts, epoch_us(ts) AS us FROM events)"


def _facts(spark, d):
    scope = F.create_map(F.lit("business_no"), F.lit("x"))
    return table(spark, d, "events").select("event_id", "user_id", bitemporal.slot_key(F.col("user_id").cast("string"), F.col("event_type"), scope).alias("slot"), "event_type", F.floor(F.col("value") / 25).alias("v"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("lineage"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def _selections(spark, d):
    f = bitemporal.open_intervals(_facts(spark, d), "slot", "ts", ["event_id"])
    return f.withColumnRenamed("ts", "valid_from").withColumns({"sys_from": F.col("valid_from"), "sys_to": F.col("valid_to")})


@query("Q01_fact_as_of", f"WITH {_FACTS}, s AS (SELECT *, lead(ts) OVER (PARTITION BY slot ORDER BY ts, event_id) AS te FROM f) SELECT slot, v, event_id FROM s WHERE ts <= TIMESTAMP '2024-01-15' AND (te IS NULL OR te > TIMESTAMP '2024-01-15')")
def fact_as_of(spark, d):
    # what was believed on the 15th about the 15th: both axes of the same interval here
    at = F.lit("2024-01-15").cast("timestamp")
    return bitemporal.as_of(_selections(spark, d), at, at).select("slot", "v", "event_id")


@query("Q01_as_of_probe_join", f"WITH {_FACTS}, p AS (SELECT o_orderkey, o_custkey % 150 AS u, TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919 % 2592000)::BIGINT) AS at FROM orders) SELECT o_orderkey, x.event_id AS fact_event_id, x.v AS fact_v FROM p LEFT JOIN LATERAL (SELECT event_id, v FROM f WHERE slot = p.u || ':click:' AND f.ts <= p.at ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 1) x ON true")
def as_of_probe_join(spark, d):
    o = table(spark, d, "orders")
    at = (F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (F.col("o_orderkey") * 7919 % 2592000) * 1_000_000).alias("at")
    probes = o.select("o_orderkey", F.concat((F.col("o_custkey") % 150).cast("string"), F.lit(":click:")).alias("slot"), at)
    out = bitemporal.as_of_join(probes, _facts(spark, d), ["slot"], "at", "us", "event_id", ["event_id", "v"])
    return out.select("o_orderkey", "fact_event_id", "fact_v")


@query("Q02_slot_history", f"WITH {_FACTS} SELECT slot, string_agg(v::VARCHAR, ',' ORDER BY ts, event_id) AS history FROM f GROUP BY 1")
def slot_history(spark, d):
    return _facts(spark, d).groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "v"))).alias("h")).select("slot", F.array_join(F.transform("h", lambda x: x["v"].cast("string")), ",").alias("history"))


@query("Q03_timeline_nulls_last", "WITH e AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS t FROM orders), m AS (SELECT l_orderkey, count(*) AS members FROM lineitem GROUP BY 1) SELECT o_orderkey, t::DATE::VARCHAR AS day, coalesce(members, 0) AS members FROM e LEFT JOIN m ON l_orderkey = o_orderkey ORDER BY t IS NULL, t, o_orderkey LIMIT 100")
def timeline(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"))
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return evidence.timeline(e, m, "o_orderkey", "at", 100).select("o_orderkey", F.to_date("at").cast("string").alias("day"), "members")


@query("Q04_query_analysis", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'evolution' ELSE 'current' END AS intent, CASE WHEN o_orderkey % 2 = 0 THEN '2000-06-15' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS since FROM orders")
def query_analysis(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("过去一年的变化")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 现在"))).alias("q"))
    a = evidence.analyze(o, "q", F.lit("2001-06-15 10:00:00").cast("timestamp"))
    return a.select("o_orderkey", "intent", F.date_format("window_from", "yyyy-MM-dd").alias("since"))


@query("Q05_event_retrieval", """WITH a AS (SELECT c_nationkey AS q, c_custkey AS e, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer), b AS (SELECT c_nationkey AS q, c_custkey AS e, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer WHERE c_mktsegment = 'BUILDING'),
u AS (SELECT q, e, 0 AS ch, rn FROM a WHERE rn <= 20 UNION ALL SELECT q, e, 1, rn FROM b WHERE rn <= 30), f AS (SELECT q, e, min(ch * 1000 + rn) AS o FROM u GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, e) AS place FROM f QUALIFY place <= 25),
s AS (SELECT q, e, round(CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE (c_custkey % 100) / 100.0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.15 ELSE 0 END, 6) AS score FROM p JOIN customer ON c_custkey = e) SELECT q, e, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, e)::INTEGER AS rn FROM s QUALIFY rn <= 12""")
def event_retrieval(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("e"), "c_acctbal", "c_mktsegment")
    a = c.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c_acctbal"), "e")))
    b = c.filter("c_mktsegment = 'BUILDING'").withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("e")))
    boost = c.select("q", "e", F.when(F.col("e") % 4 != 0, (F.col("e") % 100) / 100).alias("relevance"), F.lit(1.0).alias("decay"), (F.col("c_mktsegment") == "BUILDING").alias("entity_hit"))
    return evidence.retrieve([(a, 20), (b, 30)], "q", "e", boost, scored=25)


@query("Q06_gateway_top_k", "WITH f AS (SELECT o_custkey, l_orderkey, l_linenumber, l_suppkey % 5 AS lin, row_number() OVER (PARTITION BY o_custkey, l_suppkey % 5 ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber)::INTEGER AS rn FROM f WHERE n = 1 QUALIFY rn <= 3")
def gateway_top_k(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("lin"))
    return evidence.gateway(table(spark, d, "orders"), m, "o_custkey", "l_orderkey", "lin", [F.col("l_orderkey"), F.col("l_linenumber")], 3).select("o_custkey", "l_orderkey", "l_linenumber", "rn")


@query("Q07_evidence_pack", "WITH o AS (SELECT o_custkey, list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey)[1:4] AS x FROM orders GROUP BY 1) SELECT c_custkey, coalesce(len(x), 0)::INTEGER AS n, coalesce(list_aggregate(list_transform(x, lambda y: y.o_orderkey || y.o_orderstatus), 'string_agg', ','), '') AS orders FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def evidence_pack(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    p = evidence.pack(table(spark, d, "customer").select("c_custkey"), {"orders": (o, ["o_orderkey", "o_orderstatus"], 4)}, "c_custkey")
    return p.select("c_custkey", F.size("orders").alias("n"), F.array_join(F.transform("orders", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("orders"))


@query("Q08_slim_pack_prompt", """SELECT n_nationkey, '{"n_name":"' || n_name || '","suppliers":[' || coalesce((SELECT string_agg('{"s_suppkey":' || s_suppkey || '}', ',' ORDER BY s_suppkey) FROM (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 3)), '') || ']}' AS prompt FROM nation""")
def slim_pack(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return evidence.render(evidence.pack(table(spark, d, "nation").select("n_nationkey", "n_name"), {"suppliers": (s, ["s_suppkey"], 3)}, "n_nationkey"), "n_nationkey")


@query("Q10_dashboard_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'toxic', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def dashboard(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "labels")
    return evidence.counts({"orders": (o, None), "open": (o, F.col("o_orderstatus") == "O"), "documents": (table(spark, d, "documents"), None), "toxic": (l, F.col("toxic") == 1), "vectors": (table(spark, d, "embeddings"), None)})


@query("Q11_stage_status", "SELECT event_type AS stage, arg_max(user_id, (ts, event_id)) AS last_user, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY 1")
def stage_status(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query("Q13_observability_tail", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type = 'click' ORDER BY event_id DESC LIMIT 40")
def observability_tail(spark, d):
    return evidence.tail(table(spark, d, "events"), 500, 40, F.col("event_type") == "click").select("event_id", "event_type")


@query("Q14_queue_depths", "SELECT o_orderpriority AS topic, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS running FROM orders GROUP BY 1")
def queue_depths(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("topic"), status.alias("s")).count().groupBy("topic").pivot("s", ["done", "pending", "running"]).sum("count").fillna(0)


@query("A01_slot_keys", "SELECT event_id, user_id || ':' || event_type || ':k=' || (props->>'k') || '|m=x' AS slot FROM events")
def slot_keys(spark, d):
    scope = F.create_map(F.lit("m"), F.lit("x"), F.lit("business_no"), F.lit("n"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("empty"), F.lit(""))
    return table(spark, d, "events").select("event_id", bitemporal.slot_key(F.col("user_id").cast("string"), F.col("event_type"), scope).alias("slot"))


@query("A02_claim_subjects", "SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'obj' || (props->>'k') WHEN user_id % 2 = 0 THEN 'act' || user_id ELSE 'obj' || (props->>'k') END AS subject FROM events")
def claim_subjects(spark, d):
    actors = F.when(F.col("user_id") % 2 == 0, F.array(F.concat(F.lit("act"), F.col("user_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    objects = F.array(F.concat(F.lit("obj"), F.get_json_object("props", "$.k")))
    return table(spark, d, "events").select("event_id", bitemporal.claim_subject(F.col("event_type"), ("purchase", "view"), actors, objects).alias("subject"))


_DECIDED = f"{_FACTS}, p AS (SELECT *, lag(v) OVER w AS pv, lag(lineage) OVER w AS pl, lag(us) OVER w AS pt, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY slot ORDER BY us, event_id)), dd AS (SELECT *, CASE WHEN rn = 1 THEN 'first_seen' WHEN v IS NOT DISTINCT FROM pv THEN CASE WHEN lineage IS NOT DISTINCT FROM pl THEN 'duplicate' ELSE 'support' END WHEN us > pt THEN 'state_transition' WHEN us = pt THEN 'conflict' ELSE 'needs_review' END AS decision FROM p)"


@query("A05_slot_decisions", f"WITH {_DECIDED} SELECT event_id, decision FROM dd")
def slot_decisions(spark, d):
    return bitemporal.decide_by_predecessor(_facts(spark, d), "slot", ["us", "event_id"], "v", "lineage", "us").select("event_id", "decision")


def _folded(spark, d):
    f = _facts(spark, d).select("slot", "event_id", F.col("v").cast("string").alias("value"), F.col("lineage").cast("string").alias("lineage"), F.col("us").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.col("us").alias("sys_time"), F.lit(False).alias("correction"))
    return bitemporal.fold(f, "slot", ["sys_time", "event_id"])


@query("A06_slot_selections", f"WITH {_FACTS}, g AS (SELECT *, lag(v) OVER (PARTITION BY slot ORDER BY us, event_id) AS pv FROM f), k AS (SELECT *, lead(us) OVER (PARTITION BY slot ORDER BY us, event_id) AS nx FROM g WHERE pv IS NULL OR v <> pv) SELECT slot, v::VARCHAR AS value, us AS valid_from, NULL::BIGINT AS valid_to, us AS sys_from, nx AS sys_to FROM k UNION ALL SELECT slot, v::VARCHAR, us, nx, nx, NULL FROM k WHERE nx IS NOT NULL")
def slot_selections(spark, d):
    return _folded(spark, d).select("slot", "value", "valid_from", "valid_to", "sys_from", "sys_to")


@query("A06_open_selection_unique", f"WITH {_FACTS} SELECT slot, 1::BIGINT AS n_open FROM f GROUP BY 1")
def open_selection_unique(spark, d):
    return _folded(spark, d).filter("sys_to IS NULL AND valid_to IS NULL").groupBy("slot").agg(F.count(F.lit(1)).alias("n_open"))


@query("A07_change_cards", f"WITH {_DECIDED} SELECT DISTINCT slot, decision AS kind, pv AS before, v AS after FROM dd WHERE (decision = 'state_transition' AND event_type IN ('purchase', 'click')) OR decision = 'conflict'")
def change_cards(spark, d):
    decided = bitemporal.decide_by_predecessor(_facts(spark, d), "slot", ["us", "event_id"], "v", "lineage", "us")
    return bitemporal.change_cards(decided, "slot", "event_type", ["purchase", "click"], "v", ["us", "event_id"]).select("slot", "kind", "before", "after")


@query("A09_retraction", "SELECT event_id AS assertion_id, CASE WHEN event_id % 10 = 0 THEN 'retracted' ELSE 'active' END AS status, CASE WHEN event_id % 10 = 0 OR event_id % 3 = 0 THEN 1 ELSE 0 END AS closed FROM events")
def retraction(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("assertion_id"))
    a, s = bitemporal.retract(e.withColumn("status", F.lit("active")), e.withColumn("sys_to", F.when(F.col("assertion_id") % 3 == 0, F.lit(1))), e.filter("assertion_id % 10 = 0"), F.lit(2))
    return a.join(s, "assertion_id").select("assertion_id", "status", F.when(F.col("sys_to").isNotNull(), 1).otherwise(0).alias("closed"))


@query("A10_evidence_rows", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS evidence_no, turn AS quote FROM conversations QUALIFY evidence_no < 3")
def evidence_rows(spark, d):
    q = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("q"))
    return bitemporal.evidence_rows(q, "conv_id", "q").select("conv_id", "evidence_no", "quote")
