"""R: relational primitives on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins, merge
from .registry import query, table


@query("R01_inner_join", """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def inner_join(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("R02_left_joins", """SELECT c_custkey, n_name, r_name, o_orderkey, l_linenumber FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def left_joins(spark, d):
    c, n, r, o, l = (table(spark, d, t) for t in ("customer", "nation", "region", "orders", "lineitem"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    out = out.join(o.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").join(l.filter("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", "o_orderkey", "l_linenumber")


@query("R03_self_join_pairs", """SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'""")
def self_join_pairs(spark, d):
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    a, b = l.withColumnRenamed("l_partkey", "a"), l.withColumnRenamed("l_partkey", "b")
    return a.join(b, "l_orderkey").filter("a < b").select("a", "b").distinct()


@query("R04_band_join_time", """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000 AND a.event_id < b.event_id""")
def band_join_time(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    right = e.select(F.col("event_id").alias("b"), "user_id", "event_type", F.col("at").alias("b_at"))
    return joins.band_join(e.withColumnRenamed("event_id", "a"), right, ["user_id", "event_type"], "at", "b_at", 86_400_000_000).filter("a < b").select("a", "b")


_SPANS = "SELECT o_custkey, o_orderkey, date_trunc('day', o_orderdate) AS lo, date_trunc('day', o_orderdate) + INTERVAL 30 DAY AS hi FROM orders"


@query("R05_interval_overlap", f"WITH s AS ({_SPANS}) SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND greatest(a.lo, b.lo) <= least(a.hi, b.hi)")
def interval_overlap(spark, d):
    day = F.unix_date(F.to_date("o_orderdate"))
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("a"), day.alias("lo"), (day + 30).alias("hi"))
    b = o.select("o_custkey", F.col("a").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return o.join(b, "o_custkey").filter((F.col("a") < F.col("b")) & joins.overlap(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))).select("a", "b")


@query("R06_same_day_pairs", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.ts::DATE = b.ts::DATE AND a.event_type = b.event_type AND a.user_id = b.user_id AND a.event_id < b.event_id")
def same_day_pairs(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return e.withColumnRenamed("event_id", "a").join(e.withColumnRenamed("event_id", "b"), ["user_id", "event_type", "day"]).filter("a < b").select("a", "b")


@query("R07_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("R08_no_shared_entity_pairs", """WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), sp AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
shared AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM sp x JOIN sp y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey)
SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE NOT EXISTS (SELECT 1 FROM shared WHERE shared.a = a.s_suppkey AND shared.b = b.s_suppkey)""")
def no_shared_entity_pairs(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    sp = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return joins.pairs_without_shared(s, sp, "s_suppkey", "s_nationkey", "l_suppkey", "l_partkey")


@query("R09_left_stale_projection", """WITH want AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1), have AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT want.k, want.v AS requested, have.v AS indexed FROM want LEFT JOIN have USING (k) WHERE have.v IS NULL OR have.v < want.v""")
def left_stale_projection(spark, d):
    o = table(spark, d, "orders")
    both = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("o_orderstatus") != "P").alias("n"))
    return both.withColumn("indexed", F.when(F.col("n") > 0, F.col("n"))).filter("indexed IS NULL OR indexed < requested").select("k", "requested", "indexed")


@query("R10_semi_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def semi_join(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").filter("l_quantity >= 50"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name")


@query("R11_in_list", "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13, 21) GROUP BY 1")
def in_list(spark, d):
    return table(spark, d, "events").filter(F.col("user_id").isin(1, 2, 3, 5, 8, 13, 21)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("R12_scalar_subquery", "SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def scalar_subquery(spark, d):
    count = lambda t, k, out: table(spark, d, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(out))
    out = table(spark, d, "nation").select("n_nationkey", "n_name").join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left")
    return out.fillna(0, ["customers", "suppliers"])


@query("R13_nested_array_aggregate", """WITH a AS (SELECT user_id, event_type, list(DISTINCT (props->>'k')) AS ks FROM events GROUP BY ALL) SELECT user_id, (SELECT sum(len(ks)) FROM a b WHERE b.user_id = a.user_id)::BIGINT AS claims FROM (SELECT DISTINCT user_id FROM a) a""")
def nested_array_aggregate(spark, d):
    a = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_set(F.get_json_object("props", "$.k")).alias("ks"))
    return a.groupBy("user_id").agg(F.sum(F.size("ks")).alias("claims"))


@query("R14_derived_table", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n")
def derived_table(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


@query("R15_group_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def group_aggregates(spark, d):
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("R16_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT coalesce(props->>'k', '?')) AS ks FROM events GROUP BY 1")
def count_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.coalesce(F.get_json_object("props", "$.k"), F.lit("?"))).alias("ks"))


@query("R17_having", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60")
def having(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 60")


@query("R18_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("R19_order_nulls_last", """SELECT *, row_number() OVER (ORDER BY priority IS NULL, priority, o_orderkey) AS rn FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders ORDER BY priority IS NULL, priority, o_orderkey LIMIT 200)""")
def order_nulls_last(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    order = [F.col("priority").asc_nulls_last(), F.col("o_orderkey")]
    # the window sees 200 rows only
    return o.orderBy(*order).limit(200).withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("R20_paged_list", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 100")
def paged_list(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(100).limit(50).select("p_partkey", "p_name")


@query("R21_top_one_by_order", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def top_one(spark, d):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x")
    return table(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@query("R22_top_k_per_group", "SELECT c_nationkey, c_custkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 8")
def top_k_per_group(spark, d):
    return joins.top_k(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 8).select("c_nationkey", "c_custkey", F.col("rn").cast("long").alias("rn"))


@query("R23_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR || 'seed-7'), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(joins.seeded_order("doc_id", "seed-7"), "doc_id").limit(100)


@query("R24_upsert_max", "SELECT k, max(v) AS v FROM (SELECT user_id AS k, max(event_id) AS v FROM events WHERE event_type <> 'view' GROUP BY 1 UNION ALL SELECT user_id, max(event_id) FROM events GROUP BY 1) GROUP BY k")
def upsert_max(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "event_type")
    return merge.upsert_max(e.filter("event_type <> 'view'"), e, ["k"], ["v"])


@query("R25_insert_ignore", """WITH t AS (SELECT DISTINCT o_custkey AS k, 'old' AS who FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT o_custkey AS k, o_orderkey::VARCHAR AS who, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT * FROM t UNION ALL SELECT k, who FROM b WHERE rn = 1 AND k NOT IN (SELECT k FROM t)""")
def insert_ignore(spark, d):
    o = table(spark, d, "orders")
    target = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit("old").alias("who"), F.lit(0).cast("long").alias("seq")).distinct()
    batch = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("string").alias("who"), F.col("o_orderkey").alias("seq"))
    return merge.insert_ignore(target, batch, ["k"], ["seq"]).select("k", "who")


@query("R26_insert_replace", """WITH t AS (SELECT DISTINCT c_custkey AS k, c_name AS who FROM customer), b AS (SELECT o_custkey AS k, o_orderkey::VARCHAR AS who, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM t WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, who FROM b WHERE rn = 1""")
def insert_replace(spark, d):
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("who"), F.lit(0).cast("long").alias("seq"))
    batch = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("string").alias("who"), F.col("o_orderkey").alias("seq"))
    return merge.insert_replace(target, batch, ["k"], ["seq"]).select("k", "who")


@query("R27_patch_coalesce", """WITH p AS (SELECT o_custkey AS c_custkey, max(CASE WHEN o_orderstatus = 'P' THEN 'PENDING' END) AS seg FROM orders GROUP BY 1) SELECT c.c_custkey, coalesce(p.seg, c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN p USING (c_custkey)""")
def patch_coalesce(spark, d):
    patch = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", "PENDING")).alias("c_mktsegment"))
    return merge.patch_coalesce(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), patch, ["c_custkey"], ["c_mktsegment"])


@query("R28_soft_delete", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'earlier' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN NULL ELSE 'now' END AS deleted_at FROM customer")
def soft_delete(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "earlier").alias("deleted_at"))
    gone = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return merge.soft_delete(c, gone, ["c_custkey"], F.lit("now"))


@query("R29_partial_unique", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL HAVING count(*) > 1")
def partial_unique(spark, d):
    return merge.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], F.col("l_returnflag") == "N")


@query("R30_props_json", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, max(len(json_keys(props)))::INTEGER AS keys FROM events GROUP BY 1")
def props_json(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.max(F.size(F.json_object_keys("props"))).alias("keys"))


@query("R31_insert_select", "SELECT o_orderkey, o_totalprice, 'copy' AS origin FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice, 'base' FROM orders")
def insert_select(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice", F.lit("copy").alias("origin")).unionByName(o.select("o_orderkey", "o_totalprice", F.lit("base").alias("origin")))


@query("R32_existence_probe", "SELECT DISTINCT doc_id, EXISTS (SELECT 1 FROM documents b WHERE b.text = a.text AND b.doc_id < a.doc_id) AS seen FROM documents a")
def existence_probe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").select("doc_id", (F.col("first") < F.col("doc_id")).alias("seen")).distinct()


@query("R33_incident_edges", "WITH e AS (SELECT DISTINCT user_id AS src, (props->>'k')::BIGINT AS dst FROM events) SELECT src, dst FROM e WHERE src IN (3, 14, 15) OR dst IN (3, 14, 15)")
def incident_edges(spark, d):
    edges = table(spark, d, "events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst")).distinct()
    nodes = spark.range(1).select(F.explode(F.array(*(F.lit(n).cast("long") for n in (3, 14, 15)))).alias("node"))
    return joins.incident(edges, nodes)


@query("X01_grouping_sets", "SELECT l_returnflag, l_shipmode_year AS yr, count(*) AS n, (grouping(l_returnflag) * 2 + grouping(l_shipmode_year))::INTEGER AS g FROM (SELECT l_returnflag, year(l_shipdate)::INTEGER AS l_shipmode_year FROM lineitem) GROUP BY CUBE (l_returnflag, l_shipmode_year)")
def grouping_sets(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("yr"))
    return l.cube("l_returnflag", "yr").agg(F.count(F.lit(1)).alias("n"), (F.grouping("l_returnflag") * 2 + F.grouping("yr")).cast("int").alias("g"))


@query("X02_window_frames", """SELECT event_id, sum(value) OVER w AS running, lag(event_id) OVER o AS prev, lead(event_id) OVER o AS next, first_value(event_id) OVER o AS first, round(avg(value) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS around
FROM (SELECT event_id, user_id, ts, floor(value)::BIGINT AS value FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.floor("value").alias("value"))
    return e.select("event_id", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.lag("event_id").over(w).alias("prev"), F.lead("event_id").over(w).alias("next"), F.first("event_id").over(w).alias("first"), F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 6).alias("around"))


@query("X03_set_operations", "SELECT 'intersect' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tag(c.intersect(s), "intersect").union(tag(c.subtract(s), "except")).union(tag(c.union(s).distinct(), "union"))


@query("X04_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS before_n, b.n AS after_n FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1) b ON a.k = b.k")
def full_outer(spark, d):
    e = table(spark, d, "events")
    part = lambda cond, out: e.filter(cond).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias(out))
    return part(F.col("ts") < F.lit("2024-01-10").cast("timestamp"), "before_n").join(part(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"), "after_n"), "k", "full")


@query("X05_approx_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY 1")
def approx_distinct(spark, d):
    """The exact count beside the sketches, which must be within 10 % of it, and within 2 % of the rows around the median."""
    e = table(spark, d, "events")
    sketch = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.percentile_approx("value", 0.5, 1000).alias("median"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    share = e.join(sketch, "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("median")).cast("int")).alias("below"))
    found = exact.join(sketch, "event_type").join(share, "event_type")
    return found.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("users_near"), (F.abs(F.col("below") - 0.5) <= 0.02).alias("median_near"))
