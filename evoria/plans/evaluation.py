"""L: evaluation, calibration and dataset building on the driver tables (labels with scores made from lengths)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics as m
from ..operators import evaluation as ev
from .registry import query, table

_L = "l AS (SELECT doc_id, quality = 1 AS y, toxic = 1 AS y2, lang, source, round((n_chars % 997) / 997.0, 3) AS s, round((n_chars % 991) / 991.0, 3) AS s2, round((n_chars % 983) / 983.0, 3) AS s3, round((n_chars % 977) / 977.0, 3) AS s4, n_chars FROM labels JOIN documents USING (doc_id))"


def _labels(spark, d):
    part = lambda k: F.round((F.col("n_chars") % k) / float(k), 3)
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select("doc_id", (F.col("quality") == 1).alias("y"), (F.col("toxic") == 1).alias("y2"), "lang", "source", part(997).alias("s"), part(991).alias("s2"), part(983).alias("s3"), part(977).alias("s4"), "n_chars")


_AUC = "(SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) FROM l a JOIN l b ON a.y AND NOT b.y)"


@query("L01_auroc", f"WITH {_L} SELECT round({_AUC}, 6) AS auroc")
def auroc(spark, d):
    return ev.auroc(_labels(spark, d), "y", "s").select(F.round("auroc", 6).alias("auroc"))


@query("L02_best_threshold", f"WITH {_L}, t AS (SELECT DISTINCT s AS t FROM l), a AS (SELECT t, count(*) FILTER ((s >= t) = y) AS c, count(*) AS n FROM t, l GROUP BY 1) SELECT round(c / n, 6) AS accuracy, t AS threshold FROM a ORDER BY c DESC, t LIMIT 1")
def best_threshold(spark, d):
    return ev.best_threshold(_labels(spark, d), "y", "s").select(F.round("accuracy", 6).alias("accuracy"), "threshold")


_BIN = "SELECT least(floor(s * 10), 9)::INTEGER AS bin, count(*) AS n, avg(s) AS m, avg(y::INT) AS p FROM l GROUP BY 1"


@query("L03_ece", f"WITH {_L}, b AS ({_BIN}) SELECT round(sum(n * abs(p - m)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return ev.ece(_labels(spark, d), "y", "s").select(F.round("ece", 6).alias("ece"))


@query("L04_reliability", f"WITH {_L}, b AS ({_BIN}) SELECT bin, n, round(m, 6) AS mean_score, round(p, 6) AS positives FROM b")
def reliability(spark, d):
    return ev.reliability(_labels(spark, d), "y", "s").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("positives", 6).alias("positives"))


@query("L05_metrics_by_layer", f"WITH {_L}, x AS (SELECT 'all' AS layer, * FROM l UNION ALL SELECT lang, * FROM l) SELECT a.layer, round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM x a JOIN x b ON a.layer = b.layer AND a.y AND NOT b.y GROUP BY 1")
def metrics_by_layer(spark, d):
    l = _labels(spark, d)
    both = l.withColumn("layer", F.explode(F.array(F.lit("all"), "lang")))
    return ev.auroc(both, "y", "s", ["layer"]).filter("auroc IS NOT NULL").select("layer", F.round("auroc", 6).alias("auroc"))


@query("L06_teacher_agreement", f"WITH {_L} SELECT round(avg(CASE WHEN (s >= 0.5) = (s2 >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM l")
def teacher_agreement(spark, d):
    return _labels(spark, d).agg(F.round(F.avg(F.when((F.col("s") >= 0.5) == (F.col("s2") >= 0.5), 1.0).otherwise(0.0)), 6).alias("agreement"))


@query("L07_cascade_escalation", f"WITH {_L} SELECT count(*) FILTER (abs(s - 0.5) <= 0.2) AS escalated, round(avg(CASE WHEN abs(s - 0.5) <= 0.2 THEN s2 ELSE s END), 6) AS mean FROM l")
def cascade(spark, d):
    up = m.escalates(F.col("s"), 0.2)
    return _labels(spark, d).agg(F.count_if(up).alias("escalated"), F.round(F.avg(F.when(up, F.col("s2")).otherwise(F.col("s"))), 6).alias("mean"))


@query("L08_band_routing", f"WITH {_L} SELECT CASE WHEN s >= 0.9 THEN 'SAME' WHEN s <= 0.1 THEN 'DIFF' ELSE 'GRAY' END AS route, count(*) AS n FROM l GROUP BY 1")
def band_routing(spark, d):
    return _labels(spark, d).groupBy(m.route(F.col("s")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("L09_band_stats", f"WITH {_L} SELECT round(avg((s >= 0.9 AND NOT y)::INT), 6) AS false_merge, round(avg((s <= 0.2 AND y)::INT), 6) AS miss, round(avg((s <= 0.2)::INT), 6) AS auto_reject, round(avg((s >= 0.9 OR s <= 0.2)::INT), 6) AS coverage, round(avg((s < 0.9 AND s > 0.2)::INT), 6) AS escalation FROM l")
def band_stats(spark, d):
    b = ev.band_stats(_labels(spark, d), "y", "s", 0.9, 0.2)
    return b.select(*(F.round(c, 6).alias(c) for c in b.columns))


@query("L10_temperature_sigmoid", f"WITH {_L} SELECT doc_id, round(1 / (1 + exp(-(s * 8 - 4) / 0.75)), 6) AS p FROM l")
def temperature_sigmoid(spark, d):
    return _labels(spark, d).select("doc_id", F.round(m.sigmoid(F.col("s") * 8 - 4, 0.75), 6).alias("p"))


@query("L11_fit_temperature", f"WITH {_L}, x AS (SELECT CASE WHEN y THEN 1 ELSE -1 END * round(s * 8 - CASE WHEN y THEN 2 ELSE 5 END, 2) AS z FROM l), g AS (SELECT unnest(range(50, 10001)) / 1000.0 AS t), n AS (SELECT t, sum(ln(1 + exp(-abs(z / t))) + greatest(-z / t, 0)) AS loss FROM g, x GROUP BY t) SELECT round(arg_min(t, loss), 2) AS temperature FROM n")
def fit_temperature(spark, d):
    l = _labels(spark, d).withColumn("z", F.col("s") * 8 - F.when(F.col("y"), 2).otherwise(5))
    t = ev.fit_temperature(l, "y", "z")
    return spark.range(1).select(F.lit(round(t, 2)).alias("temperature"))


@query("L12_ensemble", f"WITH {_L} SELECT doc_id, round(1 / (1 + exp(-((0.5 * (8 * s - 4) + 0.3 * (8 * s2 - 4) + 0.2 * (8 * s3 - 4)) / 1.0) / 1.5)), 6) AS p FROM l")
def ensemble(spark, d):
    z = [F.col(c) * 8 - 4 for c in ("s", "s2", "s3")]
    return _labels(spark, d).select("doc_id", F.round(m.ensemble(z, [0.5, 0.3, 0.2], 1.5), 6).alias("p"))


@query("L13_and_gate", f"WITH {_L} SELECT count(*) FILTER (s >= 0.6 AND s2 >= 0.4) AS passed FROM l")
def and_gate(spark, d):
    return _labels(spark, d).agg(F.count_if(m.and_gate(F.col("s"), F.col("s2"), 0.6, 0.4)).alias("passed"))


@query("L14_median_gate", f"WITH {_L} SELECT doc_id, CASE WHEN list_median([s, s2, s3, s4]) >= 0.5 THEN 1.0 ELSE 0.02 END AS label FROM l".replace("list_median([s, s2, s3, s4])", "list_aggregate([s, s2, s3, s4], 'median')"))
def median_gate(spark, d):
    return _labels(spark, d).select("doc_id", m.median_gate([F.col(c) for c in ("s", "s2", "s3", "s4")], F.lit(1.0), 0.5).alias("label"))


@query("L15_majority_vote", f"WITH {_L}, v AS (SELECT (s >= 0.5)::INT + (s2 >= 0.5)::INT + (s3 >= 0.5)::INT + (s4 >= 0.5)::INT AS n FROM l) SELECT CASE WHEN n IN (0, 4) THEN 'unanimous' WHEN n = 2 THEN 'split' ELSE 'majority' END AS kind, count(*) AS n FROM v GROUP BY 1")
def majority_vote(spark, d):
    v = m.votes([F.col(c) for c in ("s", "s2", "s3", "s4")])
    return _labels(spark, d).groupBy(m.vote_kind(v, 4).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("L16_rescue_rate", f"WITH {_L} SELECT round(avg(CASE WHEN (s >= 0.5) <> y THEN ((s2 >= 0.5) = y)::INT END), 6) AS rescue, round(avg(CASE WHEN NOT y THEN (s2 >= 0.5)::INT END), 6) AS false_same FROM l")
def rescue_rate(spark, d):
    y, s, s2 = F.col("y"), F.col("s") >= 0.5, F.col("s2") >= 0.5
    return _labels(spark, d).agg(F.round(F.avg(F.when(s != y, (s2 == y).cast("int"))), 6).alias("rescue"), F.round(F.avg(F.when(~y, s2.cast("int"))), 6).alias("false_same"))


@query("L17_stratified_sample", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR || 'strata'), doc_id) AS n FROM documents WHERE lang IN ('en', 'fr', 'de')) WHERE n <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 20 ELSE 10 END")
def stratified_sample(spark, d):
    return ev.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", {"en": 30, "fr": 20, "de": 10}, "doc_id", "strata").select("doc_id")


@query("L18_pair_mining", f"WITH {_L} SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.y THEN 'P1' ELSE 'P2' END AS origin FROM l a JOIN l b ON a.source = b.source AND a.lang = b.lang AND a.y = b.y AND a.doc_id < b.doc_id AND a.y2 = b.y2 UNION ALL SELECT a.doc_id, b.doc_id, 'N1' FROM l a JOIN l b ON a.source = b.source AND a.lang = b.lang AND a.y AND NOT b.y")
def pair_mining(spark, d):
    l = _labels(spark, d)
    a, b = l.select("source", "lang", F.col("doc_id").alias("a"), F.col("y").alias("ya"), F.col("y2").alias("ta")), l.select("source", "lang", F.col("doc_id").alias("b"), F.col("y").alias("yb"), F.col("y2").alias("tb"))
    pairs = a.join(b, ["source", "lang"])
    pos = pairs.filter("ya = yb AND ta = tb AND a < b").select("a", "b", F.when(F.col("ya"), "P1").otherwise("P2").alias("origin"))
    return pos.unionByName(pairs.filter("ya AND NOT yb").select("a", "b", F.lit("N1").alias("origin")))


# every document with the three before and the three after it in its source and language, in both orders
_PAIRS = "r AS (SELECT doc_id, source, lang, substr(text, 1, 80) AS t, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.t AS ta, b.t AS tb FROM r a JOIN r b ON a.source = b.source AND a.lang = b.lang AND abs(a.r - b.r) BETWEEN 1 AND 3)"


@query("L19_pair_dedupe_unordered", f"WITH {_PAIRS} SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY least(ta, tb), greatest(ta, tb) ORDER BY a, b) = 1")
def pair_dedupe(spark, d):
    ranked = table(spark, d, "documents").select("source", "lang", "doc_id", F.substring("text", 1, 80).alias("t"), F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")).alias("r"))
    a = ranked.select("source", "lang", F.col("doc_id").alias("a"), F.col("t").alias("ta"), F.explode(F.array(*(F.col("r") + i for i in (-3, -2, -1, 1, 2, 3)))).alias("r"))
    b = ranked.select("source", "lang", F.col("doc_id").alias("b"), F.col("t").alias("tb"), "r")
    return ev.dedupe_pairs(a.join(b, ["source", "lang", "r"]), "ta", "tb", ["a", "b"]).select("a", "b")


@query("L20_margin_gate", f"WITH {_L}, f AS (SELECT (list(s ORDER BY s))[count(*) // 2 + 1] - 0.1 AS floor FROM (SELECT s FROM l ORDER BY doc_id LIMIT 2000)) SELECT doc_id, CASE WHEN s < floor THEN 'easy' WHEN s2 >= 0.5 THEN 'promoted' ELSE 'hard' END AS kind FROM l, f")
def margin_gate(spark, d):
    l = _labels(spark, d)
    floor = ev.positional_median(l, "s", "doc_id", 2000) - 0.1
    return l.select("doc_id", F.when(F.col("s") < floor, "easy").when(F.col("s2") >= 0.5, "promoted").otherwise("hard").alias("kind"))


@query("L21_time_split", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'dev' ELSE 'test' END AS split FROM r")
def time_split(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return ev.time_split(o, ["o_orderdate", "o_orderkey"], buckets="month").select("o_orderkey", "split")


@query("L22_negative_sampling", f"WITH {_L}, p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR || 'neg'), doc_id) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS size FROM l WHERE NOT y), q AS (SELECT doc_id AS pos_id, lang, ('0x' || substr(sha256(doc_id::VARCHAR || 'neg'), 1, 8))::BIGINT AS h, unnest(range(0, 3)) AS j FROM l WHERE y) SELECT pos_id, j::INTEGER AS j, p.doc_id AS neg_id FROM q JOIN p ON p.lang = q.lang AND p.slot = (q.h + q.j) % p.size")
def negative_sampling(spark, d):
    l = _labels(spark, d)
    pos = l.filter("y").select(F.col("doc_id").alias("pos_id"), "lang")
    return ev.negatives(pos, l.filter("NOT y").select("doc_id", "lang"), "lang", 3, "neg", "doc_id").select("pos_id", F.col("_j").alias("j"), F.col("doc_id").alias("neg_id"))


@query("L23_label_sharpening", f"WITH {_L} SELECT doc_id, CASE WHEN s2 < 0.3 THEN s WHEN s2 > 0.6 THEN greatest(s, 0.75) ELSE least(s, 0.25) END AS label FROM l")
def label_sharpening(spark, d):
    return _labels(spark, d).select("doc_id", m.sharpen(F.col("s"), F.when(F.col("s2") >= 0.3, F.col("s2") > 0.6)).alias("label"))


@query("L24_class_downsample", "SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id < 10 UNION ALL (SELECT event_id FROM events WHERE NOT (event_type = 'purchase' AND user_id < 10) ORDER BY sha256(event_id::VARCHAR || 'down'), event_id LIMIT (SELECT count(*) * 6 FROM events WHERE event_type = 'purchase' AND user_id < 10))")
def class_downsample(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_type") == "purchase") & (F.col("user_id") < 10)).alias("y"))
    return ev.downsample(e, "y", "event_id", 6, "down").select("event_id")


@query("L25_label_clip_smooth", f"WITH {_L} SELECT doc_id, greatest(0.05, least(0.95, s)) AS clipped, round(s * (1 - 2 * 0.05) + 0.05, 6) AS smooth FROM l")
def label_clip(spark, d):
    return _labels(spark, d).select("doc_id", m.clip(F.col("s")).alias("clipped"), F.round(m.smooth(F.col("s"), 0.05), 6).alias("smooth"))


@query("L26_source_histogram", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def source_histogram(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("L27_decision_explode", f"WITH {_L}, x AS (SELECT doc_id, unnest([{{'c': 'a', 'p': s}}, {{'c': 'b', 'p': s2}}]) AS x FROM l) SELECT doc_id, x.c AS candidate, x.p AS p FROM x")
def decision_explode(spark, d):
    x = F.explode(F.array(F.struct(F.lit("a").alias("c"), F.col("s").alias("p")), F.struct(F.lit("b").alias("c"), F.col("s2").alias("p")))).alias("x")
    return _labels(spark, d).select("doc_id", x).select("doc_id", F.col("x.c").alias("candidate"), F.col("x.p").alias("p"))


@query("L28_intra_pairs_capped", "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.label ORDER BY a.r, b.r) AS n FROM r a JOIN r b ON a.label = b.label AND b.r IN (a.r + 1, a.r + 3)) SELECT label, a, b FROM p WHERE n <= 20")
def intra_pairs(spark, d):
    return ev.intra_pairs(table(spark, d, "embeddings"), "label", "vec_id", [1, 3], 20)


@query("L29_lineage_pairs", "SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id")
def lineage_pairs(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return t.withColumnRenamed("doc_id", "a").join(t.withColumnRenamed("doc_id", "b"), "h").filter("a < b").select("a", "b")


_PATHS = "t AS (SELECT p_partkey, [p_type, p_brand, p_size::VARCHAR] AS g, CASE WHEN p_partkey % 3 = 0 THEN [p_type, p_brand, p_size::VARCHAR] ELSE list_concat([p_type, p_brand, p_size::VARCHAR][1:(p_partkey % 3)::INT], ['X', 'Y', 'Z'][1:(3 - p_partkey % 3)::INT]) END AS p FROM part)"


def _paths(spark, d):
    g, k = F.array("p_type", "p_brand", F.col("p_size").cast("string")), (F.col("p_partkey") % 3).cast("int")
    made = F.concat(F.slice(g, F.lit(1), k), F.slice(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), F.lit(1), 3 - k))
    return table(spark, d, "part").select("p_partkey", g.alias("g"), F.when(k == 0, g).otherwise(made).alias("p"))


@query("L30_hier_metrics", f"WITH {_PATHS}, x AS (SELECT g, p, list_transform(range(1, len(g) + 1), lambda i: list_aggregate(g[1:i], 'string_agg', '/')) AS pg, list_transform(range(1, len(p) + 1), lambda i: list_aggregate(p[1:i], 'string_agg', '/')) AS pp FROM t) SELECT round(avg((g = p)::INT), 6) AS leaf, round(avg((g[1] = p[1])::INT), 6) AS l1, round(avg((g[2] = p[2])::INT), 6) AS l2, round(avg((g[3] = p[3])::INT), 6) AS l3, round(avg(2.0 * len(list_intersect(pg, pp)) / (len(g) + len(p))), 6) AS hf1 FROM x")
def hier_metrics(spark, d):
    h = ev.hierarchical(_paths(spark, d), "g", "p")
    return h.select(*(F.round(c, 6).alias(c) for c in h.columns))


@query("L30_macro_f1", f"WITH {_PATHS}, r AS (SELECT g[2] AS g, p[2] AS p FROM t), c AS (SELECT g AS c, count(*) FILTER (g = p) AS tp, count(*) FILTER (g <> p) AS fn FROM r GROUP BY 1), f AS (SELECT p AS c, count(*) FILTER (g <> p) AS fp FROM r GROUP BY 1) SELECT round(avg(2.0 * tp / (2 * tp + fn + coalesce(fp, 0))), 6) AS macro_f1 FROM c LEFT JOIN f USING (c)")
def macro_f1(spark, d):
    return ev.macro_f1(_paths(spark, d), F.get("g", F.lit(1)), F.get("p", F.lit(1))).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("L31_group_accuracy", f"WITH {_L} SELECT source, dimension, round(avg(ok::INT), 6) AS accuracy FROM (SELECT source, 'quality' AS dimension, (s >= 0.5) = y AS ok FROM l UNION ALL SELECT source, 'toxic', (s2 >= 0.5) = y2 FROM l) GROUP BY ALL")
def group_accuracy(spark, d):
    l = _labels(spark, d).select("source", ((F.col("s") >= 0.5) == F.col("y")).alias("quality"), ((F.col("s2") >= 0.5) == F.col("y2")).alias("toxic"))
    return l.unpivot("source", ["quality", "toxic"], "dimension", "ok").groupBy("source", "dimension").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"))


@query("L32_conf_bands", f"WITH {_L}, t AS (SELECT unnest([0.5, 0.7, 0.9]) AS t) SELECT t::DOUBLE AS threshold, count(*) FILTER (s >= t) AS n, round(avg(CASE WHEN s >= t THEN y::INT END), 6) AS precision, round(avg((s >= t)::INT), 6) AS coverage FROM t, l GROUP BY 1")
def conf_bands(spark, d):
    b = ev.confidence_bands(_labels(spark, d), F.col("y"), F.col("s"), [0.5, 0.7, 0.9])
    return b.select("threshold", "n", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


@query("L33_spearman", f"WITH {_L}, r AS (SELECT row_number() OVER (ORDER BY s, doc_id) AS ra, row_number() OVER (ORDER BY s2, doc_id) AS rb FROM l) SELECT round(corr(ra, rb), 6) AS rho FROM r")
def spearman(spark, d):
    return ev.spearman(_labels(spark, d), "s", "s2", "doc_id").select(F.round("rho", 6).alias("rho"))


@query("L34_adjudication_overlay", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 9 ELSE quality END AS quality FROM labels WHERE doc_id % 10 <> 7")
def adjudication(spark, d):
    l = table(spark, d, "labels").select("doc_id", "quality")
    fixes = l.filter("doc_id % 10 IN (3, 7)").select("doc_id", F.when(F.col("doc_id") % 10 == 3, "fix").otherwise("drop").alias("action"), F.lit(9).alias("new"))
    return ev.overlay(l, fixes, "doc_id", "quality")


@query("L35_quota_sample", "WITH o AS (SELECT doc_id, lang, source, sha256(doc_id::VARCHAR || 'quota') AS h FROM documents), a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, doc_id) <= 15), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= 40) SELECT doc_id FROM b ORDER BY h, doc_id LIMIT 100")
def quota_sample(spark, d):
    return ev.quota_sample(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 40, 15, 100, "quota").select("doc_id")


@query("L36_precision_at_5", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents), p AS (SELECT source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS p FROM r LEFT JOIN labels USING (doc_id) WHERE rn <= 5 GROUP BY 1) SELECT round(avg(p), 6) AS mean_p5 FROM p")
def precision_at_5(spark, d):
    from ..operators.joins import top_k

    top = top_k(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 5)
    hit = F.when(F.col("quality") == 1, 1.0).otherwise(0.0)
    return top.join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.avg(hit).alias("p")).agg(F.round(F.avg("p"), 6).alias("mean_p5"))


@query("L37_line_metrics", "WITH c AS (SELECT user_id AS c, count(*) AS n, count(DISTINCT event_type) AS kinds, max(value) AS top FROM events GROUP BY 1) SELECT count(*) AS clusters, round(avg(n), 4) AS mentions_per_cluster, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, round(avg(CASE WHEN kinds > 4 THEN 1.0 ELSE 0.0 END), 4) AS mixed_share FROM c")
def line_metrics(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))
    return c.agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("n"), 4).alias("mentions_per_cluster"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.round(F.avg(F.when(F.col("kinds") > 4, 1.0).otherwise(0.0)), 4).alias("mixed_share"))


@query("L38_taxonomy_product", "SELECT r_name || '/' || n_name || '/' || p_brand AS path FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT DISTINCT p_brand FROM part)")
def taxonomy_product(spark, d):
    # the product of fixed class lists is the feature: brands are a closed list
    brands = table(spark, d, "part").select("p_brand").distinct()
    top = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return top.join(brands).select(F.concat_ws("/", "r_name", "n_name", "p_brand").alias("path"))


@query("L39_top_down_descent", "WITH l1 AS (SELECT p_partkey, p_type AS a FROM part), n AS (SELECT p_type AS a, p_brand AS b, count(*) AS n FROM part GROUP BY ALL), best AS (SELECT a, b FROM n QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1) SELECT p_partkey, a || '/' || b AS path FROM l1 JOIN best USING (a)")
def top_down(spark, d):
    from ..operators.joins import top_k

    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("a"), F.col("p_brand").alias("b"))
    best = top_k(p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a"], [F.desc("n"), "b"], 1).select("a", "b")
    return p.select("p_partkey", "a").join(best, "a").select("p_partkey", F.concat_ws("/", "a", "b").alias("path"))
