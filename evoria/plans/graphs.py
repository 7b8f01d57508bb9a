"""G: the property graph on the driver tables (customers, nations, regions, parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table

_EDGES = "e AS (SELECT c_custkey + 1000000 AS src, c_nationkey::BIGINT AS dst FROM customer UNION ALL SELECT n_nationkey, n_regionkey + 100 FROM nation)"
_BOTH = f"{_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _edges(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return c.union(table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), (F.col("n_regionkey") + 100).cast("long")))


def _nodes(spark, *ids):
    return spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("node"))


@query("G01_node_listing_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%green%' ORDER BY p_name, p_partkey LIMIT 50")
def node_listing(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").ilike("%green%")).orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("G02_entity_detail", "SELECT n_nationkey, n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation JOIN region ON r_regionkey = n_regionkey")
def entity_detail(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), ",").alias("suppliers"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", "n_name", "r_name", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"), "suppliers")


@query("G03_edge_listing", f"WITH {_EDGES} SELECT src, dst FROM e WHERE dst = 3 ORDER BY src LIMIT 100")
def edge_listing(spark, d):
    return _edges(spark, d).filter("dst = 3").orderBy("src").limit(100)


@query("G04_company_aggregate", "WITH f AS (SELECT c_nationkey AS node, o_orderkey AS ev, o_orderpriority AS kind, o_orderdate AS t FROM orders JOIN customer ON o_custkey = c_custkey), b AS (SELECT node, count(DISTINCT ev) AS events, min(t)::DATE::VARCHAR AS lo, max(t)::DATE::VARCHAR AS hi FROM f GROUP BY 1), k AS (SELECT node, kind, count(DISTINCT ev) AS n, row_number() OVER (PARTITION BY node ORDER BY count(DISTINCT ev) DESC, kind) AS rn FROM f GROUP BY node, kind) SELECT node, events, lo, hi, (SELECT string_agg(kind || '=' || n, ',' ORDER BY rn) FROM k WHERE k.node = b.node AND rn <= 3) AS kinds FROM b ORDER BY events DESC, node LIMIT 10")
def company_aggregate(spark, d):
    f = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("node"), F.col("o_orderkey").alias("ev"), F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("at"))
    shown = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return graph.aggregate_by(f, "node", "ev", "kind", "at", 10).select("node", "events", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), shown.alias("kinds"))


@query("G05_khop_neighbors", f"WITH {_BOTH}, h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 1000007), h2 AS (SELECT DISTINCT b.dst AS node FROM b JOIN h1 ON b.src = h1.node) SELECT 1000007 AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 WHERE node <> 1000007 UNION ALL SELECT node, 2 FROM h2 WHERE node <> 1000007 AND node NOT IN (SELECT node FROM h1)")
def khop(spark, d):
    return graph.neighbourhood(_edges(spark, d), _nodes(spark, 1_000_007), 2)


@query("G05_components", f"WITH {_EDGES} SELECT 100 + n_regionkey::BIGINT AS region, (count(DISTINCT n_nationkey) + count(c_custkey) + 1)::BIGINT AS members, min(n_nationkey)::BIGINT AS root FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def components(spark, d):
    c = graph.components(_edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return c.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max(F.when(F.col("node").between(100, 199), F.col("node"))).alias("region"))


@query("G06_induced_edges", f"WITH {_EDGES}, dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY degree DESC, node LIMIT 28) SELECT src, dst FROM e WHERE src IN (SELECT node FROM dg) AND dst IN (SELECT node FROM dg)")
def induced_edges(spark, d):
    e = _edges(spark, d)
    return graph.induced(e, graph.hubs(e, 28)).select("src", "dst")


@query("G07_add_edges", "SELECT n_nationkey::BIGINT AS src, (100 + n_regionkey)::BIGINT AS dst, 'in' AS relation, CASE WHEN n_nationkey % 4 = 1 THEN 'gone' END AS deleted_at FROM nation UNION ALL SELECT n_nationkey, 200, 'new', NULL FROM nation WHERE n_nationkey % 2 = 0")
def add_edges(spark, d):
    n = table(spark, d, "nation")
    old = n.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"), F.lit("in").alias("relation"), F.when(F.col("n_nationkey") % 2 == 1, "gone").alias("deleted_at"))
    again = old.filter("src % 4 = 3").select("src", "dst", "relation")
    new = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("src"), F.lit(200).cast("long").alias("dst"), F.lit("new").alias("relation"))
    return graph.add_edges(old, again.union(new).union(new.withColumn("dst", F.col("src"))))


def _commands(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit(1).alias("version"), "c_mktsegment")
    asked = table(spark, d, "customer").filter("c_custkey % 3 = 0").select((F.col("c_custkey") * F.when(F.col("c_custkey") % 9 == 0, -1).otherwise(1)).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(2).alias("expected"), F.lit("NEW").alias("c_mktsegment"))
    return graph.locked_update(c, asked, "c_custkey", "version", ["c_mktsegment"])


@query("G08_optimistic_updates", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 AND (c_custkey % 9 <> 0 OR c_custkey = 0) THEN 2 ELSE 1 END AS version, CASE WHEN c_custkey % 6 = 0 AND (c_custkey % 9 <> 0 OR c_custkey = 0) THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def optimistic_updates(spark, d):
    return _commands(spark, d)[0]


@query("G08_optimistic_rejects", "SELECT CASE WHEN c_custkey % 9 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 9 = 0 AND c_custkey > 0 THEN 404 ELSE 409 END AS code FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey % 9 = 0 AND c_custkey > 0 OR c_custkey % 2 = 1)")
def optimistic_rejects(spark, d):
    return _commands(spark, d)[1]


@query("G09_move_member", "SELECT vec_id, label AS cluster, CASE WHEN vec_id % 5 = 0 AND label <> 3 THEN 'now' END AS removed_at FROM embeddings UNION ALL SELECT vec_id, 3, NULL FROM embeddings WHERE vec_id % 5 = 0 AND label <> 3")
def move_member(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.lit(None).cast("string").alias("removed_at"))
    return graph.move_members(m, m.filter("vec_id % 5 = 0").select("vec_id", F.lit(3).alias("target")), "vec_id", "cluster", F.lit("now"))


_SPLIT = "r AS (SELECT label, vec_id FROM embeddings WHERE (label < 5 AND vec_id % 4 = 0) OR label = 7)"


@query("G10_split_cluster", f"WITH {_SPLIT}, n AS (SELECT label, min(vec_id) AS new FROM r WHERE label < 5 GROUP BY 1) SELECT vec_id, coalesce(CASE WHEN vec_id % 4 = 0 THEN new END, label::BIGINT + 100000) AS cluster FROM embeddings LEFT JOIN n USING (label)")
def split_cluster(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", (F.col("label") + 100_000).cast("long").alias("cluster"))
    return graph.split(m, m.filter("(cluster < 100005 AND vec_id % 4 = 0) OR cluster = 100007"), "vec_id", "cluster")[0]


@query("G10_split_rejects", "SELECT DISTINCT label::BIGINT + 100000 AS cluster, 400 AS code FROM embeddings WHERE label = 7")
def split_rejects(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", (F.col("label") + 100_000).cast("long").alias("cluster"))
    return graph.split(m, m.filter("(cluster < 100005 AND vec_id % 4 = 0) OR cluster = 100007"), "vec_id", "cluster")[1]


def _merged(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("cluster"))
    redirects = spark.range(1, 5).select(F.col("id").alias("node"), (F.col("id") - 1).alias("target"))
    edges = spark.range(0, 9).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return graph.merge(m, edges, redirects, "cluster")


@query("G11_merge_redirect", "SELECT vec_id, CASE WHEN label <= 4 THEN 0 ELSE label END::BIGINT AS cluster FROM embeddings")
def merge_redirect(spark, d):
    return _merged(spark, d)[0]


@query("G11_merge_edges", "SELECT CASE WHEN i <= 4 THEN 0 ELSE i END::BIGINT AS src, (i + 1)::BIGINT AS dst FROM range(4, 9) t(i)")
def merge_edges(spark, d):
    return _merged(spark, d)[1]


@query("G12_hub_degree", f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def hub_degree(spark, d):
    return graph.hubs(_edges(spark, d), 10)
