"""I, E, N, V, B: ingest, extraction, entities, vectors and lexical retrieval on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import entities, extract, ingest, lexical, vectors
from .registry import query, table
from .text import _BODY, _NS, _UUID


@query("I02_document_identity", f"WITH x AS (SELECT page_id, sha1(unhex('{_NS}') || encode('source' || chr(31) || 'web')) AS h, sha256('page ' || page_id) AS o FROM pages), y AS (SELECT page_id, {_UUID} AS source_id, o AS origin_id FROM x), z AS (SELECT *, sha1(unhex('{_NS}') || encode('doc' || chr(31) || source_id || chr(31) || origin_id)) AS h FROM y) SELECT page_id, source_id, origin_id, {_UUID} AS document_id FROM z")
def document_identity(spark, d):
    items = table(spark, d, "pages").select("page_id", F.lit(None).cast("string").alias("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.lit("web").alias("source_name"), F.col("html").alias("content"))
    return ingest.identify(items).select("page_id", "source_id", "origin_id", "document_id")


@query("I03_short_rejects", "SELECT doc_id, length(text) >= 60 AS accepted FROM documents")
def short_rejects(spark, d):
    good, bad = ingest.split_short(table(spark, d, "documents"), "text")
    return good.select("doc_id", F.lit(True).alias("accepted")).union(bad.select("doc_id", F.lit(False)))


@query("I04_doc_versions", "WITH f AS (SELECT source, lang, doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INTEGER AS version_no FROM f WHERE rn = 1")
def doc_versions(spark, d):
    items = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("document"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return ingest.versions(items, "document", "h", ["doc_id"]).select("doc_id", "version_no")


@query("I05_doc_duplicates", "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicate_of FROM documents")
def doc_duplicates(spark, d):
    return ingest.duplicates(table(spark, d, "documents"), "doc_id", F.col("text"), ["doc_id"]).select("doc_id", "duplicate_of")


@query("I06_lineage_kind", f"WITH x AS (SELECT doc_id, substr(sha256(substr({_BODY}, 1, 2000)), 1, 16) AS g FROM documents) SELECT doc_id, g AS lineage_group, CASE WHEN min(doc_id) OVER (PARTITION BY g) = doc_id THEN 'original' ELSE 'reprint' END AS origin_kind FROM x")
def lineage_kind(spark, d):
    return ingest.lineage(table(spark, d, "documents"), "doc_id", "text", ["doc_id"]).select("doc_id", "lineage_group", "origin_kind")


@query("I07_clean_layer", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS rn, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) SELECT doc_id, nullif(first, doc_id) AS duplicate_of FROM k WHERE rn = 1")
def clean_layer(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return ingest.clean_layer(docs, "doc_id", "source", "h").select("doc_id", "duplicate_of")


@query("I08_month_matrix_pivot", "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (month(o_orderdate) = {m}) AS m{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def month_matrix(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.concat(F.lit("m"), F.month("o_orderdate").cast("string")))
    return o.groupBy("o_orderstatus").pivot("m", [f"m{m}" for m in range(1, 13)]).count().fillna(0)


@query("I09_status_machine", "SELECT CASE WHEN n_chars % 11 = 0 THEN 'failed' WHEN n_chars % 3 = 0 THEN 'resolved' WHEN n_chars % 2 = 0 THEN 'extracted' WHEN n_chars > 60 THEN 'parsed' ELSE 'captured' END AS status, count(*) AS n FROM documents GROUP BY 1")
def status_machine(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy(ingest.status(n > 60, n % 2 == 0, n % 3 == 0, n % 11 == 0, F.lit(False)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("I10_cache_misses", "SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 3 = 0 AND b.text = a.text)")
def cache_misses(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return ingest.cache_misses(docs, docs.filter("doc_id % 3 = 0").select("h"), ["h"]).select("doc_id")


@query("I11_idempotent_stages", "SELECT DISTINCT event_type AS stage, user_id::VARCHAR AS input_ref FROM events WHERE (event_type, user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE value > 50)")
def idempotent_stages(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("input_ref"), "value")
    return ingest.pending_stages(e.select("stage", "input_ref").distinct(), e.filter("value > 50")).select("stage", "input_ref")


@query("I12_run_manifest", "SELECT 'orders' AS name, count(*) AS n, min(o_orderdate)::DATE::VARCHAR AS first FROM orders UNION ALL SELECT 'events', count(*), min(ts)::DATE::VARCHAR FROM events")
def run_manifest(spark, d):
    one = lambda t, c: table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.to_date(F.min(c)).cast("string").alias("first"))
    return one("orders", "o_orderdate").union(one("events", "ts"))


_TURNS = "SELECT conv_id, turn, role, text FROM conversations"


@query("E01_flatten_chunks", "SELECT conv_id, turn, len(regexp_extract_all(text, '[^ ]+'))::BIGINT AS n FROM conversations WHERE length(text) > 0")
def flatten_chunks(spark, d):
    chunks = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1)).alias("m"))
    return extract.flatten_chunks(chunks, "conv_id", "turn", "m").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))


@query("E02_in_document_merge", "WITH g AS (SELECT user_id, event_type, min(event_id) AS pos, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS kind, pos, n, row_number() OVER (PARTITION BY user_id ORDER BY pos)::INTEGER AS mention_no FROM g QUALIFY mention_no <= 3")
def in_document_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.upper("event_type").alias("kind"), F.array(F.col("event_id").cast("string")).alias("evidence"))
    m = extract.merge_in_document(e, "user_id", "event_id", F.col("kind"), F.lit(" a ct"), F.lit(""), "evidence", 3)
    return m.select("user_id", F.substring_index("merge_key", "|", 1).alias("kind"), "pos", F.size("evidence").cast("long").alias("n"), "mention_no")


@query("E03_mention_validity", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing_action' WHEN doc_id % 5 = 1 THEN 'missing_evidence' WHEN doc_id % 5 = 2 THEN 'evidence_not_found' END AS reason FROM documents WHERE regexp_matches(text, '[A-Za-z]{4}') AND length(text) >= 60")
def mention_validity(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").rlike("[A-Za-z]{4}") & (F.length("text") >= 60))
    k = F.col("doc_id") % 5
    quotes = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("no such words"))).otherwise(F.array(F.lit("no such words"), F.substring("text", 10, 45)))
    return docs.select("doc_id", extract.validity(F.when(k == 0, " ").otherwise("acts"), quotes, F.col("text")).alias("reason"))


@query("E04_mention_assembly", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'company' ELSE 'person' END END AS type FROM customer")
def mention_assembly(spark, d):
    c = table(spark, d, "customer")
    named = F.struct(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 2 == 1, "person").alias("type"))
    t = c.select("c_custkey", extract.clean_names(F.array(named), "company").alias("a"))
    return t.select("c_custkey", F.size("a").alias("n"), F.get("a", F.lit(0))["type"].alias("type"))


@query("N01_resolve_entities", f"""WITH k AS (SELECT n_name, n_regionkey, lower(n_name) AS nk FROM nation), u AS (SELECT DISTINCT regexp_replace(nk, ' ', '', 'g') AS nk, n_regionkey FROM k),
x AS (SELECT nk, n_regionkey, sha1(unhex('{_NS}') || encode('ent' || chr(31) || 'other' || chr(31) || nk)) AS h FROM u) SELECT nk AS norm_key, CASE WHEN n_regionkey = 0 THEN 'own-' || nk WHEN n_regionkey = 1 THEN 'ali-' || nk ELSE {_UUID} END AS entity_id, CASE n_regionkey WHEN 0 THEN 'entity' WHEN 1 THEN 'alias' ELSE 'new' END AS how FROM x""")
def resolve_entities(spark, d):
    n = table(spark, d, "nation")
    names = n.select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("type_hint"), F.col("n_nationkey").alias("seq"))
    keyed = n.withColumn("norm_key", text.entity_key(F.col("n_name")))
    own = keyed.filter("n_regionkey = 0").select("norm_key", F.concat(F.lit("own-"), "norm_key").alias("entity_id"))
    alias = keyed.filter("n_regionkey = 1").select("norm_key", F.concat(F.lit("ali-"), "norm_key").alias("entity_id"))
    return entities.resolve(names, own, alias).select("norm_key", "entity_id", "how")


@query("N02_bind_mentions", "SELECT c_custkey, 'id-' || lower(replace(n_name, ' ', '')) || ',id-' || lower(replace(r_name, ' ', '')) AS bound FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def bind_mentions(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    mentions = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.array("n_name", F.lit("nobody"), "r_name").alias("names"))
    keys = n.select(F.col("n_name").alias("x")).union(r.select("r_name")).select(text.entity_key(F.col("x")).alias("norm_key")).distinct().withColumn("entity_id", F.concat(F.lit("id-"), "norm_key"))
    return entities.bind(mentions, keys, "c_custkey", "names").select("c_custkey", F.array_join("entity_ids", ",").alias("bound"))


@query("N03_hierarchy_edges", "SELECT lower(replace(n_name, ' ', '')) AS src, lower(replace(r_name, ' ', '')) AS dst, 'part_of' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey")
def hierarchy_edges(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    keys = pairs.select(F.col("child").alias("x")).union(pairs.select("parent")).select(text.entity_key(F.col("x")).alias("norm_key")).distinct().withColumn("entity_id", F.col("norm_key"))
    return entities.seed_edges(pairs, keys)


@query("N05_dict_entity_link", """WITH t AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) || lower(replace(n_name, ' ', '')) AS body FROM documents JOIN nation ON n_nationkey = doc_id % 25), k AS (SELECT n_nationkey, lower(replace(n_name, ' ', '')) AS nk FROM nation)
SELECT doc_id, n_nationkey AS entity_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(nk) DESC, n_nationkey)::INTEGER AS rn FROM t JOIN k ON contains(body, nk) QUALIFY rn <= 5""")
def dict_entity_link(spark, d):
    n = table(spark, d, "nation")
    q = table(spark, d, "documents").join(n, F.col("n_nationkey") == F.col("doc_id") % 25).select("doc_id", F.concat("text", "n_name").alias("q"))
    return entities.link_dictionary(q, n.select(F.col("n_nationkey").alias("entity_id"), text.entity_key(F.col("n_name")).alias("norm_key")), "q", "doc_id").select("doc_id", "entity_id", "rn")


@query("N06_family_expansion", "WITH e AS (SELECT n_nationkey AS src, 100 + n_regionkey AS dst FROM nation) SELECT DISTINCT x AS entity_id FROM (SELECT unnest([3, 101]) AS x UNION SELECT src FROM e WHERE dst IN (3, 101) UNION SELECT dst FROM e WHERE src IN (3, 101))")
def family_expansion(spark, d):
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"), F.lit("part_of").alias("relation"))
    return entities.family(edges, spark.range(1).select(F.explode(F.array(F.lit(3), F.lit(101))).alias("entity_id")))


_UNIT = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


@query("V02_l2_normalize", f"{_UNIT} SELECT vec_id, round(e[1], 6) AS first, round(e[64], 6) AS last, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS total FROM u")
def l2_normalize(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", vectors.unit(vectors.doubles(F.col("embedding"))).alias("e"))
    return u.select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.get("e", F.lit(63)), 6).alias("last"), F.round(vectors.dot(F.col("e"), F.col("e")), 6).alias("total"))


@query("V03_cosine_topk", f"{_UNIT}, s AS (SELECT q.vec_id AS query_id, d.vec_id, round({_DOT.format(a='q.e', b='d.e')}, 6) AS score FROM u q JOIN u d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rn FROM s QUALIFY rn <= 10")
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.cosine_top_k(v, v.filter("vec_id % 100 = 0"), 10)


@query("V04_latest_vector", "SELECT label, arg_max(vec_id, vec_id) AS vec_id FROM embeddings GROUP BY 1")
def latest_vector(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.max_by("vec_id", "vec_id").alias("vec_id"))


@query("V06_incremental_vectorize", "WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1200)) AS s, text FROM documents) SELECT doc_id AS owner, (s // 1200)::INTEGER AS sub, sha256(substr(text, s + 1, 1200)) AS text_hash FROM c WHERE doc_id % 4 <> 0")
def incremental_vectorize(spark, d):
    # what the store holds already: the chunks of every fourth document
    c = table(spark, d, "documents").select("doc_id", F.explode(text.fixed_chunks(F.col("text"))).alias("x"))
    w = c.select(F.col("doc_id").alias("owner"), F.floor(F.col("x.start") / 1200).cast("int").alias("sub"), F.sha2(F.col("x.body").cast("binary"), 256).alias("text_hash"))
    return vectors.stale_vectors(w, w.filter("owner % 4 = 0")).select("owner", "sub", "text_hash")


_CENTER = f"{_UNIT}, f AS (SELECT label, unnest(range(1, 65)) AS pos, e FROM u), m AS (SELECT label, pos, avg(e[pos]) AS m FROM f GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), c AS (SELECT label, list(m / n ORDER BY pos) AS c FROM m JOIN n USING (label) GROUP BY 1)"


@query("V08_centroid_by_label", f"{_CENTER} SELECT label, round(c[1], 5) AS first, round(c[64], 5) AS last FROM c")
def centroid_by_label(spark, d):
    v = table(spark, d, "embeddings").withColumn("embedding", vectors.unit(vectors.doubles(F.col("embedding"))))
    c = vectors.centroids(v, "label")
    return c.select("label", F.round(F.get("centroid", F.lit(0)), 5).alias("first"), F.round(F.get("centroid", F.lit(63)), 5).alias("last"))


@query("V10_pair_dot_judge", f"{_UNIT} SELECT a.vec_id AS a, round({_DOT.format(a='a.e', b='b.e')}, 6) AS p FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def pair_dot(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", vectors.unit(vectors.doubles(F.col("embedding"))).alias("e"))
    b = u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return u.join(b, "vec_id").select(F.col("vec_id").alias("a"), F.round(vectors.dot(F.col("e"), F.col("f")), 6).alias("p"))


@query("V11_nearest_centroid", f"{_CENTER}, s AS (SELECT vec_id, c.label, round({_DOT.format(a='c.c', b='u.e')}, 6) AS score FROM u, c) SELECT vec_id, label, round(score, 4) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label)::INTEGER AS rn FROM s QUALIFY rn <= 2")
def nearest_centroid(spark, d):
    v = table(spark, d, "embeddings").withColumn("embedding", vectors.unit(vectors.doubles(F.col("embedding"))))
    return vectors.nearest(v, vectors.centroids(v, "label"), "vec_id", "embedding", "centroid", "label", 2).withColumn("score", F.round("score", 4))


_TOK = "regexp_extract_all(lower({t}), '[a-z0-9]+')"
_BM25 = f"""t AS (SELECT doc_id, {_TOK.format(t='text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, unnest(list_distinct({_TOK.format(t='text')})) AS term FROM benchmark),
sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL)"""


@query("B01_token_df_top", f"WITH t AS (SELECT doc_id, unnest(list_distinct({_TOK.format(t='text')})) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY 1 ORDER BY df DESC, term LIMIT 50")
def token_df_top(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.array_distinct(text.tokenize(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(50)


def _bm25(spark, d):
    return lexical.bm25(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("q")), "doc_id", F.col("text"), "item_id", F.col("q"))


@query("B02_bm25_query_set", f"WITH {_BM25} SELECT item_id, count(*) AS n, round(max(score), 4) AS best FROM sc WHERE score > 0 GROUP BY 1")
def bm25_query_set(spark, d):
    return _bm25(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("best"))


@query("B03_bm25_topk", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rn FROM sc WHERE score > 0 QUALIFY rn <= 5")
def bm25_topk(spark, d):
    return lexical.top(_bm25(spark, d), "item_id", "doc_id", 5).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rn")


@query("B05_pool_max_normalized", f"WITH {_BM25} SELECT item_id, doc_id, round(score / max(score) OVER (PARTITION BY item_id), 4) AS share FROM sc WHERE score > 0")
def pool_max(spark, d):
    return lexical.normalized_by_max(_bm25(spark, d), "item_id").select("item_id", "doc_id", F.round("share", 4).alias("share"))


_CHANNELS = """a AS (SELECT source AS g, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents QUALIFY rn <= 20), b AS (SELECT source AS g, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 20)"""


@query("B06_rrf_fusion", f"WITH {_CHANNELS} SELECT g, doc_id, round(sum(1.0 / (60 + rn)), 8) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("g"), "doc_id", "n_chars")
    a, b = lexical.top(docs, "g", "doc_id", 20, "n_chars"), lexical.top(docs.withColumn("s", -F.col("doc_id")), "g", "doc_id", 20, "s")
    return lexical.rrf([a.select("g", "doc_id", "rn"), b.select("g", "doc_id", "rn")], "g", "doc_id").withColumn("fused", F.round("fused", 8))


@query("B07_hybrid_search", f"""WITH {_BM25}, a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0 QUALIFY rn <= 30),
v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM embeddings),
sim AS (SELECT q.vec_id AS item_id, d.vec_id AS doc_id, round({_DOT.format(a='q.e', b='d.e')}, 6) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id), b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM sim QUALIFY rn <= 30),
f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rn)), 8) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT item_id, doc_id, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id)::INTEGER AS rn FROM f QUALIFY rn <= 10""")
def hybrid_search(spark, d):
    v = table(spark, d, "embeddings")
    dense = vectors.cosine_top_k(v, v.filter("vec_id % 50 = 0"), 30).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rn")
    words = lexical.top(_bm25(spark, d), "item_id", "doc_id", 30).select("item_id", "doc_id", "rn")
    fused = lexical.rrf([words, dense], "item_id", "doc_id").withColumn("fused", F.round("fused", 8))
    return lexical.top(fused, "item_id", "doc_id", 10, "fused").select("item_id", "doc_id", "fused", "rn")


@query("B09_chunk_max", "WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1200)) AS s, text FROM documents) SELECT doc_id, max(length(regexp_replace(substr(text, s + 1, 1200), '[^e]', '', 'g')))::INTEGER AS score FROM c GROUP BY 1")
def chunk_max(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(text.fixed_chunks(F.col("text"))).alias("x")).select("doc_id", F.length(F.regexp_replace("x.body", "[^e]", "")).alias("score"))
    return lexical.chunk_max(c, ["doc_id"])
