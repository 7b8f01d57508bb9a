"""Small cases that failed before the findings of the second round were settled."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evoria import catalog
from evoria.operators import resolution
from evoria.sources import files


def against_sql(spark, folder, name, tables):
    """Rows of a query and of its SQL over ``tables`` (name to DataFrame), written to ``folder``."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = catalog.queries()[name](spark, str(folder))
    return sorted(map(tuple, df.collect()), key=repr), sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=repr)


def test_review_csv_keeps_every_text(spark, tmp_path):
    texts = [None, "", " ", " lead", "trail \n", "\t", "a\r\nb", "\r", '"', 'a",\n1', 'ends"\n', "\\", "\\N", "\\\\N", "\\N\n", '\0"', "a\0b", "null"]
    rows = [(i, t, 1 if i % 10 else None) for i, t in enumerate(texts)]
    files.write_review(spark.createDataFrame(rows, "doc_id long, text string, human int"), f"{tmp_path}/r")
    back, standing = files.read_review(spark, f"{tmp_path}/r", "doc_id long, text string, human int", "human")
    assert sorted(map(tuple, back.collect())) == rows and standing == "human"


def test_scores_round_as_in_sql(spark):
    con = duckdb.connect()
    said = [r[0] for r in con.sql("SELECT round(round_even(0.34 * x + 0.26 * x + 0.16 * 1.0 + 0.14 * 0.5 + 0.05 * 0.0 + 0.05, 4), 3) FROM (SELECT i / 20000 AS x FROM range(20000) t(i) ORDER BY i)").fetchall()]
    x = F.col("id") / 20000
    score = resolution.feature_score(x, x, F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(True))
    assert [r[0] for r in spark.range(20000).orderBy("id").select(resolution.rounded(score, 3)).collect()] == said


def test_clusters_of_vectors_are_those_of_their_pairs(spark):
    import random

    from evoria.operators import vectors

    rng = random.Random(5)
    rows = [(i, i % 3 if i % 20 else None, None if i == 7 else [rng.gauss(0, 1) + (i % 5 == j) for j in range(6)]) for i in range(150)]
    v = spark.createDataFrame(rows, "node long, `group` long, v array<double>")
    u = v.filter("v IS NOT NULL").select("group", "node", vectors.unit(F.col("v")).alias("v"))
    pairs = u.select("group", F.col("node").alias("a"), F.col("v").alias("x")).join(u.select("group", F.col("node").alias("b"), F.col("v").alias("y")), "group").filter("a < b").select("a", "b", F.round((vectors.dot(F.col("x"), F.col("y")) + 1) / 2, 4).alias("p"))
    assert sorted(resolution.vector_correlation_clusters(v).collect()) == sorted(resolution.correlation_clusters(v.select("node"), pairs).collect())


def test_vector_clusters_keep_no_pairs():
    import tracemalloc

    import numpy as np

    x = np.random.default_rng(1).normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    resolution.cluster_vectors(x, list(range(3000)), rounds=1)
    assert tracemalloc.get_traced_memory()[1] < 3000 * 3000 * 8 / 2
    tracemalloc.stop()


def test_the_mean_itself_decides_on_a_proposal(spark):
    edges = spark.createDataFrame([(1, 2, 0.4999), (2, 3, 0.5), (1, 3, 0.5)], "a long, b long, p double")
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, cluster long")
    assert [(r["p"], r["action"]) for r in resolution.proposals(nodes, edges).collect()] == [(0.5, "none")]


def test_best_window_is_the_first_of_the_fullest():
    import random

    from evoria.functions import text

    rng = random.Random(3)
    for _ in range(300):
        body = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 120)))
        tokens = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(5)]
        starts = list(range(0, max(len(body) - 12 - 1, 0) + 1, 4))
        assert text.best_window(body, tokens, 12, 4) == max(starts, key=lambda s: (sum(t in body[s : s + 12] for t in set(tokens)), -s))


def test_best_snippet_of_a_long_text(spark):
    import time

    from evoria.functions import text

    body = "x" * 1_200_000 + "needle" + "y" * 300
    began = time.time()
    df = spark.createDataFrame([(body,), ("short needle",), (None,)], "t string")
    found = [r[0] for r in df.select(text.best_snippet(F.col("t"), F.array(*(F.lit(w) for w in ["needle", *(f"w{i}" for i in range(60))])))).collect()]
    assert "needle" in found[0] and found[1:] == ["short needle", None]
    assert time.time() - began < 30  # the windows alone were 20,000 walks from the text's start for each token


def test_day_slices_meet_by_value(spark):
    rows = [(i, i % 2, 1, 0.5) for i in range(3000)] + [(5000 + i, i % 2, 2, 0.51) for i in range(3000)] + [(9000, 0, 3, 0.9), (9001, None, 3, 0.5), (9002, 0, 3, None)]
    df = spark.createDataFrame(rows, "mention long, key long, day int, x double").localCheckpoint()
    kept = []

    def keep(x):
        kept.append(x._jdf.queryExecution().optimizedPlan().toString())
        return x.localCheckpoint()

    seen = dict(map(tuple, resolution.day_slices(df, 0.97, keep).collect()))
    assert all(seen[i] == i for i in range(3000)) and all(seen[5000 + i] == i % 2 for i in range(3000))
    assert [seen[i] for i in (9000, 9001, 9002)] == [9000, 9001, 9002]
    # clusters of one x are one row before they meet mentions
    assert "min(cluster" in kept[1]


def test_pair_links_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(2)
    micros = 86_400_000_000
    rows = [(i, rng.choice(["p", "q", None]), rng.choice([1, 2, 3, 4, None]), rng.choice([None, *(rng.randrange(400) * micros + rng.choice([0, 1]) for _ in range(9))]), rng.choice([None, *range(60)])) for i in range(160)]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is not None and a[1] == b[1]:
                near = (a[3] is None and b[3] is None) or (a[3] is not None and b[3] is not None and abs(a[3] - b[3]) <= 40 * micros)
                if (a[2] is not None and a[2] == b[2] and near) or (a[4] is not None and a[4] == b[4]):
                    links[a[0]] += 1
                    links[b[0]] += 1
                    x, y = sorted((find(a[0]), find(b[0])))
                    root[y] = x
    found = resolution.pair_links(spark.createDataFrame(rows, "id long, kind string, entity long, at long, day int"), 40).collect()
    assert sorted(map(tuple, found)) == [(i, find(i), links[i]) for i in sorted(links)]
    assert 1 < len({find(i) for i in links}) < 100


def test_recall_takes_the_first_of_a_key_before_it_joins(spark, tmp_path):
    rows = spark.range(1, 2001).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(F.col("id") % 90).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k":1}').alias("props"))
    found, said = against_sql(spark, tmp_path, "C01_multi_channel_recall", {"events": rows})
    assert found == said and len(found) == 800
    plan = catalog.queries()["C01_multi_channel_recall"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") >= 3  # both channels are cut before their joins, the pool after them


def test_cosine_search_meets_in_matrices(spark):
    import random

    from pyspark.sql.window import Window

    from evoria.operators import vectors

    rng = random.Random(4)
    rows = [(i % 190, [rng.choice([-1.0, 0.0, 0.5, 2.0]) + (rng.random() if i % 3 else 0.0) for _ in range(4)]) for i in range(200)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [1.0, 2.0]), (303, [0.0] * 4), (304, [float("nan"), 1.0, 0.0, 0.0]), (305, []), (None, [1.0] * 4)]
    rows += [(400 + i, [1.0, 1.0, 0.0, 1e-9 * i]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = v.select("vec_id", vectors.unit(vectors.doubles(F.col("embedding"))).alias("e"))
    for k, asked in ((10, "vec_id % 7 = 0 OR vec_id BETWEEN 300 AND 305"), (235, "vec_id % 20 = 0 OR vec_id BETWEEN 300 AND 305")):
        q = v.filter(asked)
        pairs = u.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")).join(u).filter("query_id <> vec_id")
        scored = pairs.select("query_id", "vec_id", F.round(vectors.dot(F.col("q"), F.col("e")), 6).alias("score"))
        said = scored.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rn") <= k)
        found = vectors.cosine_top_k(v, q, k)
        assert sorted(map(repr, found.select("query_id", "vec_id", "score", "rn").collect())) == sorted(map(repr, said.collect()))
        # no row for each pair
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_norm_is_computed_once_for_a_vector(spark):
    import time

    from evoria.operators import vectors

    began = time.time()
    v = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double")).alias("v"))
    assert v.select(F.size(vectors.unit(F.col("v")))).collect()[0][0] == 20_000
    assert time.time() - began < 10  # once for every component were 400 million steps


def test_scores_of_words_stay_with_their_document(spark, tmp_path):
    import random

    from evoria.operators import lexical

    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(60)] + [(100, ""), (101, "zz yy"), (102, "A a\tb, B")]
    # two rows of one id and length are one document
    docs += [(7, docs[7][1])]
    asked = [(i, " ".join(word() for _ in range(6))) for i in range(9)] + [(20, "a a unseen"), (21, ""), (22, None)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string"), "benchmark": spark.createDataFrame(asked, "item_id long, text string")}
    for name in ("B02_bm25_query_set", "B03_bm25_topk", "B05_pool_max_normalized"):
        found, said = against_sql(spark, tmp_path, name, tables)
        assert found == said and found
    d, q = tables["documents"].filter("doc_id <> 7"), tables["benchmark"].withColumnRenamed("text", "q")
    scores = lexical.bm25(d, q, "doc_id", F.col("text"), "item_id", F.col("q"))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert scores.count() and "Exchange" not in plan and "Join" not in plan
    assert "Window" not in lexical.normalized_by_max(scores, "item_id")._jdf.queryExecution().executedPlan().toString()
    assert lexical.bm25(d, q.filter("item_id = 21"), "doc_id", F.col("text"), "item_id", F.col("q")).count() == 0


def test_slots_share_a_state(spark, tmp_path, monkeypatch):
    from evoria.operators import bitemporal
    from evoria.streaming import streams

    monkeypatch.setattr(streams, "SLOT_GROUPS", 3, raising=False)
    rows = [(f"s{i % 11}" if i % 13 else None, i, str(i % 4), str(i % 3), i // 2, None, i // 2, False) for i in range(200)]
    schema = "slot string, id long, value string, lineage string, valid_from long, valid_to long, sys_time long, correction boolean"
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/facts.parquet")
    q = streams.slot_decisions(streams.table_stream(spark, str(tmp_path), "facts"), "slot", "id").writeStream.format("memory").queryName("slots_seen").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    held, said = {}, []
    names = ["value", "lineage", "valid_from", "valid_to", "sys_time", "correction"]
    for r in rows:
        held[r[0]], decision, _ = bitemporal.step(held.get(r[0]), dict(zip(names, r[2:], strict=True)))
        said.append((r[1], r[0], decision))
    assert sorted(map(tuple, spark.table("slots_seen").select("id", "slot", "decision").collect())) == said
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3


def test_structured_recall_deals_only_hits_that_count(spark):
    mentions = spark.createDataFrame([(1, "R", 5, 9, [1, 2, 2]), (2, "R", None, None, [1]), (3, "Q", 0, 99, [2, 3])], "mention long, kind string, lo long, hi long, entities array<long>")
    members = spark.createDataFrame([(1, 10), (2, 10), (2, 10), (1, 11), (2, 12), (1, 13), (3, 10)], "entity long, cluster long")
    clusters = spark.createDataFrame([(10, "R", 1, 5), (11, "R", 9, 12), (12, "R", 10, 12), (13, "R", None, None), (10, "Q", 7, 7)], "cluster long, kind string, lo long, hi long")
    found = resolution.structured_recall(mentions, members, clusters, 8)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 2, 1), (1, 11, 1, 2), (2, 13, 1, 1), (3, 10, 2, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # times are compared below the only place where hits are dealt
    assert "RepartitionByExpression [mention" in plan
    assert plan.index("RepartitionByExpression [mention") < plan.index("c_lo")


def test_pairs_without_a_shared_part_are_not_shuffled(spark, tmp_path):
    import random

    rng = random.Random(8)
    supplier = spark.createDataFrame([(i, i % 3 if i % 17 else None) for i in range(60)], "s_suppkey long, s_nationkey int")
    lineitem = spark.createDataFrame([(rng.randrange(65), rng.randrange(40)) for _ in range(200)], "l_suppkey long, l_partkey long")
    found, said = against_sql(spark, tmp_path, "R08_no_shared_entity_pairs", {"supplier": supplier, "lineitem": lineitem})
    assert found == said and found
    plan = catalog.queries()["R08_no_shared_entity_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan


def test_few_names_are_looked_for_without_grams(spark, monkeypatch):
    from evoria.operators import entities

    texts = spark.createDataFrame([(1, "Ab c abcd"), (2, "x"), (3, None), (4, "BCD 车企 a"), (5, "")], "id long, q string")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["ab", "abc", "bcd", "a", "", "车企a", "cab", "ab"])], "entity_id long, norm_key string")
    found = entities.link_dictionary(texts, names, "q", "id")
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(entities, "FEW_NAMES", 0)
    assert rows == sorted(map(tuple, entities.link_dictionary(texts, names, "q", "id").collect())) and len(rows) == 7
