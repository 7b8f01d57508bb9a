"""The remaining operators: small scalars, audits, feeds, index flavours, memberships."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times
from ..operators import bitemporal, extract, graph, ingest, joins, lexical, merge, resolution as res, vectors
from ..streaming import streams
from .registry import query, table
from .text import _NS, _UUID


@query("T19_list_coercion", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS n FROM orders")
def list_coercion(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.size(text.as_list(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))).alias("n"))


@query("T14_event_card", """WITH e AS (SELECT event_type AS kind, list(user_id::VARCHAR) AS a, list(props->>'k') AS o, count(*) AS n, count(DISTINCT user_id) AS g, min(ts)::DATE::VARCHAR AS lo FROM events GROUP BY 1) SELECT kind, 'type: ' || kind || chr(10) || 'actors: ' || list_aggregate(list_sort(list_distinct(a))[1:4], 'string_agg', '、') || chr(10) || 'objects: ' || list_aggregate(list_sort(list_distinct(o))[1:4], 'string_agg', '、') || chr(10) || 'action: did' || chr(10) || 'time: ' || lo || '~?' || chr(10) || 'facts: ' || list_aggregate(list_sort(list_distinct(o))[1:6], 'string_agg', '、') || chr(10) || 'sources: ' || g || ' reports: ' || n AS card FROM e""")
def event_card(spark, d):
    # sets of ids and keys, not rows, are gathered for a kind
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.collect_set(F.col("user_id").cast("string")).alias("a"), F.collect_set(F.get_json_object("props", "$.k")).alias("o"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("g"), F.to_date(F.min("ts")).cast("string").alias("lo"))
    return e.select("kind", text.event_card(F.col("kind"), F.col("a"), F.col("o"), F.lit("did"), F.col("lo"), F.lit(None).cast("string"), F.col("o"), F.col("g"), F.col("n")).alias("card"))


@query("T26_display_truncation", "SELECT doc_id, substr(text, 1, 40) AS shown FROM documents")
def display_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shown(F.col("text"), 40).alias("shown"))


@query("D05_lenient_iso", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN '+08:00' WHEN 1 THEN '+00:00' ELSE '-03:30' END AS iso FROM events")
def lenient_iso(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-0330'"))
    return table(spark, d, "events").select("event_id", times.lenient_iso(said).alias("iso"))


@query("D09_overlap_predicate", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < l_shipdate + INTERVAL 10 DAY AND l_shipdate < o_orderdate + INTERVAL 30 DAY")
def overlap_predicate(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    o, s = F.col("o_orderdate"), F.col("l_shipdate")
    return j.filter(joins.half_open_overlap(o, o + F.expr("INTERVAL 30 DAY"), s, s + F.expr("INTERVAL 10 DAY"))).agg(F.count(F.lit(1)).alias("n"))


@query("E05_standalone_assertions", "SELECT doc_id, substr(text, 1, 30) AS quote FROM documents WHERE regexp_matches(substr(text, 1, 30), '^[A-Za-z ]+$') AND length(substr(text, 1, 30)) >= 6")
def standalone_assertions(spark, d):
    docs = table(spark, d, "documents").filter(F.substring("text", 1, 30).rlike("^[A-Za-z ]+$"))
    q = F.substring("text", 1, 30)
    return docs.filter(extract.validity(F.lit("states"), F.array(q), F.col("text")).isNull()).select("doc_id", q.alias("quote"))


@query("E07_repair_revalidate", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS kind FROM events WHERE event_type IN ('view', 'click')")
def repair_revalidate(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    return e.select("event_id", text.event_type(F.col("event_type"), ("click",), {"view": "click"}).alias("kind"))


@query("N04_seed_aliases", "SELECT DISTINCT n_nationkey AS entity_id, lower(replace(n_name, ' ', '')) || r.x AS norm_key FROM nation, (SELECT unnest(['', 'region']) AS x) r")
def seed_aliases(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("entity_id"), F.explode(F.array("n_name", F.concat("n_name", F.lit(" region")), F.upper("n_name"))).alias("alias"))
    return merge.first_writer(n.withColumn("norm_key", text.entity_key(F.col("alias"))), ["entity_id", "norm_key"], ["alias"]).select("entity_id", "norm_key")


@query("N07_mention_entity_ids", "SELECT l_orderkey, list_aggregate(list_sort(list_distinct(list(l_partkey::VARCHAR) || list('s' || l_suppkey))), 'string_agg', ',') AS ids FROM lineitem GROUP BY 1")
def mention_entity_ids(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("a"), F.collect_list(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("b"))
    return l.select("l_orderkey", F.array_join(F.array_sort(F.array_distinct(F.concat("a", "b"))), ",").alias("ids"))


@query("V01_dimension_check", "SELECT vec_id, vec_id % 10 <> 0 AS good FROM embeddings")
def dimension_check(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("v"))
    good, bad = vectors.checked_dimension(v, "v", 64)
    return good.select("vec_id", F.lit(True).alias("good")).union(bad.select("vec_id", F.lit(False)))


@query("V05_deactivate", "SELECT vec_id, label <> 4 AS active FROM embeddings")
def deactivate(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("owner"), F.lit(True).alias("active"))
    return vectors.deactivate(v, v.filter("owner = 4")).select("vec_id", "active")


@query("V07_embedding_cache", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS cached_from FROM documents")
def embedding_cache(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("m").alias("model_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    cache = merge.first_writer(docs, ["model_id", "text_hash"], ["doc_id"]).withColumnRenamed("doc_id", "cached_from")
    return docs.join(cache, ["model_id", "text_hash"]).select("doc_id", "cached_from")


@query("V09_representative_vectors", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS rep_no FROM embeddings QUALIFY rep_no <= 5")
def representative_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.own_representatives(v.select("label", "vec_id"), v.select("vec_id", "embedding"), "label", "vec_id", ["vec_id"]).select("label", "vec_id", "rep_no")


@query("B04_index_flavours", "SELECT doc_id, length(lang || ' ' || source || ' ' || substr(text, 1, 4000))::INTEGER AS document, length(lang || ' ' || source)::INTEGER AS cluster FROM documents")
def index_flavours(spark, d):
    doc = lexical.index_text("document", title=F.col("lang"), source=F.col("source"), body=F.col("text"))
    cluster = lexical.index_text("cluster", summary=F.col("lang"), frame=F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.length(doc).alias("document"), F.length(cluster).alias("cluster"))


@query("B08_choice_rerank", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 100 DESC, doc_id)::INTEGER AS rn FROM documents WHERE doc_id % 5 <> 0")
def choice_rerank(spark, d):
    a = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("doc_id"), (F.col("n_chars") % 100).alias("mass"))
    return lexical.choice_rank(a, "source", "doc_id", "mass").select("source", "doc_id", "rn")


@query("C06_coverage_health", "SELECT user_id, count(DISTINCT event_type) >= 5 AND count(*) FILTER (value > 499) = 0 AS ok FROM events GROUP BY 1")
def coverage_health(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("channels"), F.count_if(F.col("value") > 499).alias("stale"))
    return e.select("user_id", res.coverage_ok(F.col("channels"), F.col("stale"), 5).alias("ok"))


@query("C08_pair_features", "SELECT p_partkey, round(CASE WHEN p_size > 40 THEN 0.5 ELSE greatest(0.0, 1 - p_size / 30.0) END, 6) AS t, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 1.0 END AS loc FROM part")
def pair_features(spark, d):
    p = table(spark, d, "part")
    gap = F.when(F.col("p_size") <= 40, F.col("p_size"))
    loc = res.location_feature(F.create_map(F.lit("m"), F.lit("x"), F.lit("n"), F.lit("z")), F.create_map(F.lit("m"), F.lit("x"), F.lit("n"), F.when(F.col("p_size") % 2 == 0, "y").otherwise("z")))
    return p.select("p_partkey", F.round(res.time_feature(gap, 30), 6).alias("t"), loc.cast("double").alias("loc"))


@query("C09_unique_id_anchor", "SELECT a.event_id AS mention, min(b.event_id) AS anchor FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id AND (a.props->>'k') = (b.props->>'k') GROUP BY 1")
def unique_id_anchor(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"))
    pairs = e.select("user_id", F.col("event_id").alias("mention"), F.col("k").alias("own")).join(e.select("user_id", F.col("event_id").alias("cluster"), F.col("k").alias("other")), "user_id").filter("cluster < mention")
    return res.anchor(pairs, "mention", "cluster", "own", "other")


@query("C12_judge_shortlist", "SELECT c_nationkey AS mention, c_custkey AS cluster FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING')::INT DESC, c_acctbal DESC, c_custkey) <= 24")
def judge_shortlist(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("mention"), F.col("c_custkey").alias("cluster"), (F.col("c_mktsegment") == "BUILDING").alias("hit"), F.col("c_acctbal").alias("bm25"))
    return res.judge_shortlist(c, "mention", "cluster", "hit", "bm25").select("mention", "cluster")


@query("C13_identity_notes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'size' ELSE '' END AS anchors, CASE WHEN p_size % 2 = 1 THEN 'size,' ELSE '' END || 'brand' AS conflicts FROM part")
def identity_notes(spark, d):
    same, differ = res.identity_notes([("size", F.col("p_size") % 2, F.lit(0)), ("brand", F.col("p_brand"), F.lit("none")), ("sku", F.lit(None).cast("string"), F.col("p_brand"))])
    return table(spark, d, "part").select("p_partkey", F.array_join(same, ",").alias("anchors"), F.array_join(differ, ",").alias("conflicts"))


@query("C16_apply_plans", "SELECT event_id AS mention, CASE WHEN event_id % 4 = 0 THEN event_id ELSE user_id END AS cluster, CASE WHEN event_id % 4 = 0 THEN 'create_low' ELSE 'attach_bypass' END AS action FROM events WHERE event_id % 4 <> 3")
def apply_plans(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    plans = e.select(F.col("event_id").alias("mention"), F.when(k == 0, "create_low").when(k == 3, "pending").otherwise("attach_bypass").alias("action"), F.col("user_id").alias("target"))
    none = plans.limit(0).select("mention", F.col("target").alias("cluster"), "action")
    return res.apply_plans(none, plans)


@query("C20_related_processes", "SELECT DISTINCT least(a.event_type, b.event_type) AS a, greatest(a.event_type, b.event_type) AS b, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def related_processes(spark, d):
    p = table(spark, d, "events").select("user_id", "event_type").distinct()
    return p.withColumnRenamed("event_type", "a").join(p.withColumnRenamed("event_type", "b"), "user_id").filter("a < b").select("a", "b", "user_id")


@query("C21_decision_audit", "SELECT c_nationkey AS mention, 'judge' AS action, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS candidates FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5) GROUP BY 1")
def decision_audit(spark, d):
    ranked = joins.top_k(table(spark, d, "customer").select(F.col("c_nationkey").alias("mention"), F.col("c_custkey").alias("cluster"), F.col("c_acctbal").alias("score")), ["mention"], ["cluster"], 5)
    plans = ranked.select("mention").distinct().withColumn("action", F.lit("judge"))
    return res.decision_audit(plans, ranked).select("mention", "action", F.array_join(F.transform("candidates", lambda c: c["cluster"].cast("string")), ",").alias("candidates"))


@query("A03_standalone_path", "SELECT event_type AS subject, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def standalone_path(spark, d):
    claims = table(spark, d, "events").filter("event_id % 2 = 0").select(F.col("event_type").alias("subject"))
    alone = table(spark, d, "orders").select(F.col("o_orderstatus").alias("subject"))
    return claims.unionByName(alone).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("A04_assertion_ids", f"WITH x AS (SELECT event_id, sha1(unhex('{_NS}') || encode('assert' || chr(31) || user_id || chr(31) || event_type || chr(31) || '' || chr(31) || event_id)) AS h FROM events) SELECT event_id, {_UUID} AS id FROM x")
def assertion_ids(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", bitemporal.assertion_id(F.col("user_id").cast("string"), F.col("event_type"), F.lit(None).cast("string"), F.col("event_id").cast("string")).alias("id"))


@query("A08_correction_edges", "WITH l AS (SELECT event_id, lag(event_id) OVER w AS p, floor(value / 25) AS v, lag(floor(value / 25)) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) SELECT event_id AS src, p AS dst, 'contradicts' AS relation FROM l WHERE p IS NOT NULL AND v <> pv")
def correction_edges(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    v = F.floor(F.col("value") / 25)
    e = table(spark, d, "events").select(F.col("event_id").alias("src"), F.lag("event_id").over(w).alias("dst"), (v != F.lag(v).over(w)).alias("differs"))
    return e.filter("dst IS NOT NULL AND differs").select("src", "dst", F.lit("contradicts").alias("relation"))


@query("Q09_global_timeline", "SELECT kind, id FROM (SELECT 'order' AS kind, o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS t FROM orders UNION ALL SELECT 'ship', l_orderkey, l_shipdate FROM lineitem WHERE l_linenumber = 1) ORDER BY t IS NULL, t, kind, id LIMIT 60")
def global_timeline(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("t"))
    l = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.lit("ship"), "l_orderkey", "l_shipdate")
    return o.union(l).orderBy(F.col("t").asc_nulls_last(), "kind", "id").limit(60).select("kind", "id")


@query("Q12_change_feed", "SELECT o_orderkey, c_name, o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def change_feed(spark, d):
    o = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "o_orderstatus")


@query("S04_table_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def table_round_trip(spark, d):
    return graph.store(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))


@query("S11_event_stream_sink", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def event_stream_sink(spark, d):
    return streams.drain(streams.table_stream(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "event_type"))


@query("M08_observability_emit", "SELECT event_type AS stage, count(*) AS n, count(*) FILTER (value > 400) AS warnings FROM events GROUP BY 1")
def observability(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 400).alias("warnings"))




@query("S02_push_ingest", "SELECT i::BIGINT AS seq, CASE WHEN i % 2 = 0 THEN 'content_too_short' END AS reason FROM range(0, 6) t(i)")
def push_ingest(spark, d):
    items = [{"url": f"https://e.com/{i}", "title": f"t{i}", "source_name": "api", "content": "word " * (20 if i % 2 else 3)} for i in range(6)]
    good, bad = ingest.split_short(ingest.identify(ingest.push(spark, items)))
    return good.select("seq", F.lit(None).cast("string").alias("reason")).union(bad.select("seq", "reason"))


@query("I13_replay", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def replay(spark, d):
    path = f"{graph.shared_folder(spark)}/evoria/replay-stage-{spark.sparkContext.applicationId}"
    stage = lambda: table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    ingest.replay(stage, path)
    return ingest.replay(stage, path)


@query("E06_ordered_commit", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn)::INTEGER AS commit_no FROM conversations ORDER BY conv_id, turn LIMIT 200")
def ordered_commit(spark, d):
    done = table(spark, d, "conversations").repartition(8).select("conv_id", "turn")
    first = ingest.in_order(done, ["conv_id", "turn"]).limit(200)
    return first.withColumn("commit_no", F.row_number().over(Window.orderBy("conv_id", "turn")))


@query("V12_cached_matrix", "SELECT vec_id, label FROM embeddings WHERE label = 2")
def cached_matrix(spark, d):
    # a stored copy by role stands for the in-memory matrix: it is read again, not computed again
    return graph.store(table(spark, d, "embeddings").filter("label = 2").select("vec_id", "label", "embedding")).select("vec_id", "label")
