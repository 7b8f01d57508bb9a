"""Literal cases of the functions and operators."""

import uuid

import pytest
from pyspark.sql import functions as F

from evoria.functions import ids, metrics, text, times, udfs, urls
from evoria.operators import bitemporal, evaluation, graph, joins, merge, resolution
from evoria.sources import files
from evoria.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("said,at,precision", [("2026-09-01T10:20:30Z", "2026-09-01 18:20:30", "second"), ("2026-09-01T10:20:30-05:00", "2026-09-01 23:20:30", "second"), ("2026-09-01T10:20:30", "2026-09-01 10:20:30", "second"), ("1700000000", "2023-11-15 06:13:20", "second"), ("1700000000.5", "2023-11-15 06:13:20.500000", "second"), ("2026-09-01 10:20", "2026-09-01 10:20:00", "minute"), ("2026年9月1日（周二）", "2026-09-01 00:00:00", "day"), ("2026.9.1", "2026-09-01 00:00:00", "day"), ("2026/9/1", "2026-09-01 00:00:00", "day"), ("2026年9月", "2026-09-01 00:00:00", "month"), ("2026", "2026-01-01 00:00:00", "year"), ("on 2026-9-3 or so", "2026-09-03 00:00:00", "day"), ("about 2019", "2019-01-01 00:00:00", "year"), ("2026-02-30", "2026-02-01 00:00:00", "month"), ("nothing", None, None), ("", None, None)])
def test_parse_time(spark, said, at, precision):
    x = one(spark, times.parse_time(F.lit(said)))
    assert (x and (str(x["at"]), x["precision"])) == (at and (at, precision))


def test_event_time(spark):
    get = lambda lo, hi, pt=None: one(spark, times.event_time(F.lit(lo).cast("string"), F.lit(hi).cast("string"), F.lit(pt).cast("string"), F.lit("unknown")))
    assert [str(x)[:10] for x in get("2024-03-05", "2024-03-01")] == ["2024-03-01", "2024-03-05", "day"]
    assert str(get("2024-03", None)["lower"])[:10] == "2024-03-01" and get("2024-03", None)["upper"] is None
    assert str(get(None, "2024-12")["upper"])[:10] == "2025-01-01"
    assert str(get(None, None, "2023")["upper"])[:10] == "2024-01-01"
    assert get(None, None)["precision"] == "unknown"
    assert get("2199-01-01", None)["precision"] == get(None, None, "2199-01-01")["precision"] == get("2006-01-01", "2199-01-01")["precision"] == "unknown"
    assert [str(x)[:10] for x in get("2006-01-01", "2024-03-01")] == ["None", "2024-03-01", "day"] and get("2024-03-01", "2199-01-01")["upper"] is None


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            x = spark.range(1).select(times.parse_time(F.lit("2024-03-10 02:30:00"))["at"].cast("string").alias("at"), times.event_time(F.lit("2024-03"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("unknown"))["lower"].cast("string").alias("lower")).first()
            assert tuple(x) == ("2024-03-10 02:30:00", "2024-03-01 00:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("said,tokens", [("Hello W0rld", ["hello", "w0rld"]), ("中", ["中"]), ("中文", ["中", "中文", "文"]), ("中文字", ["中", "中文", "文", "文字", "字"]), ("a中b文", ["中", "文", "a", "b"]), ("", []), (None, []), ("ＡＢ１ Ⅳ ﬁn", ["ab1", "iv", "fin"]), ("金文", ["金", "金文", "文"]), ("cafe\u0301 bar", ["caf", "bar"])])
def test_tokenize(spark, said, tokens):
    assert one(spark, text.tokenize(F.lit(said).cast("string"))) == tokens


def test_nfkc(spark):
    assert one(spark, text.nfkc(F.lit("ＡＢ１"))) == "AB1"


@pytest.mark.parametrize("url,want", [("HTTP://Example.COM/a/?UTM_Source=x&b=2#f", "http://example.com/a?b=2"), ("https://e.com", "https://e.com/"), ("https://e.com:8080/p/?q=", "https://e.com:8080/p"), ("//e.com/x", "https://e.com/x"), ("https://e.com/?token=YWJj==&a=b==", "https://e.com/?token=YWJj%3D%3D&a=b%3D%3D"), ("https://e.com/p?q=a%20b+c&x=%7E*%zz&n=%E4%B8%AD", "https://e.com/p?q=a+b+c&x=~%2A%25zz&n=%E4%B8%AD"), ("\u3000https://e.com/a \n", "https://e.com/a"), ("https://[::1/x ", "https://[::1/x"), ("https://[::1]/x", "https://[::1]/x"), ("mailto:a@b.c", "mailto:a@b.c"), ("https://e.com/?%66rom=x&k=1", "https://e.com/?k=1")])
def test_urls(spark, url, want):
    assert one(spark, urls.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize("name,key", [("Acme Corp", "acme"), ("Acme (Co) Ltd", "acme"), ("蔚来汽车", "蔚来"), ("华为技术有限公司", "华为"), ("ab公司", "ab"), ("公司", "公司"), (None, "")])
def test_entity_keys(spark, name, key):
    assert one(spark, text.entity_key(F.lit(name).cast("string"))) == key


def test_quotes(spark):
    body, quote = "first line\nthe  quick​ brown fox jumps over the lazy dog and then it sleeps", "the quick brown fox jumps"
    span = one(spark, text.quote_span(F.lit(body), F.lit(quote)))
    flat = one(spark, text.match_form(F.lit(body)))
    assert flat[span["start"] : span["end"]] == one(spark, text.match_form(F.lit(quote)))
    assert one(spark, text.quote_span(F.lit(body), F.lit("fox"))) is None
    assert one(spark, text.quote_span(F.lit(body), F.lit("not in the text"))) is None


def test_quotes_are_found_in_every_place(spark):
    import random

    from evoria.operators import extract

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6))) for _ in range(n))
    docs = [(i, words(120)) for i in range(12)] + [(50, None), (51, "")]
    quotes = []
    for i, t in docs[:12]:
        for n in (6, 20, 30, 41, 90):
            at = rng.randrange(len(t) - n)
            quotes.append((len(quotes), t[at : at + n]))
        at = rng.randrange(len(t) - 90)
        quotes.append((len(quotes), "XX" + t[at + 2 : at + 78] + "YYYYYYYYYYYY"))
    quotes += [(1000, "abc"), (1001, None), (1002, "not in any of these texts at all, nowhere")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item long, q string")
    got = {(r["item"], r["doc_id"], r["span"]["start"], r["span"]["end"]) for r in extract.find_quotes(d, q, "doc_id", "text", "item", "q").collect()}
    every = d.crossJoin(q).select("item", "doc_id", text.quote_span(F.col("text"), F.col("q")).alias("span")).filter("span IS NOT NULL").collect()
    assert got == {(r["item"], r["doc_id"], r["span"]["start"], r["span"]["end"]) for r in every} and len(got) >= 60


def test_uuid5_is_the_standard_one(spark):
    want = str(uuid.uuid5(ids.NAMESPACE, "a\x1fé\x1f3"))
    assert one(spark, ids.uuid5(F.lit("a"), F.lit("é"), F.lit("3"))) == want


@pytest.mark.parametrize("said,want", [('```json\n{"b":1,"a":[1,2,],}\n```', '{"a":[1,2],"b":1}'), ('<think>{"x":0}</think> {"a": "un', '{"a":"un"}'), ('{"a": 1, "b', '{"a":1}'), ('[1, [2, 3', "[1,[2]]"), ("no json", None), (None, None), ('{"a": ["x, ]", 1,], "b": {"c": 2', '{"a":["x, ]",1],"b":{}}'), ('{"a": 1' + ", ,1" * 500, '{"a":1}')])
def test_json_repair(said, want):
    assert udfs.repair_json(said) == want


def test_chunks(spark):
    t = "。".join("x" * 700 for _ in range(12))
    c = udfs.chunk_text(t, 3000, 500)
    assert all(len(x) <= 3000 for x in c) and c[0].endswith("。") and c[-1] == t[-len(c[-1]) :]
    udfs.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM evoria_chunks('abc', 2, 1)").first()["n"] == 2


def test_slot_fold(spark):
    facts = [("s", 1, "a", "l1", 10, None, 1, False), ("s", 2, "a", "l1", 11, None, 2, False), ("s", 3, "a", "l2", 12, None, 3, False), ("s", 4, "b", "l2", 20, None, 4, False), ("s", 5, "c", "l3", 20, None, 5, False), ("s", 6, "d", "l3", 20, None, 6, False), ("s", 7, "e", "l3", None, None, 7, True), ("s", 8, "f", "l3", 5, None, 8, False)]
    df = spark.createDataFrame(facts, "slot string, id long, value string, lineage string, valid_from long, valid_to long, sys_time long, correction boolean")
    out = bitemporal.fold(df, "slot", ["sys_time", "id"]).collect()
    assert [r["decision"] for r in sorted(out, key=lambda r: (r["sys_from"], r["valid_from"]))] == ["first_seen", "state_transition", "state_transition", "conflict", "conflict", "correction"]
    open_rows = [r for r in out if r["sys_to"] is None and r["valid_to"] is None]
    assert len(open_rows) == 1 and open_rows[0]["value"] == "e"
    state, said = None, []
    for f in facts:
        state, d, _ = bitemporal.step(state, dict(zip(["value", "lineage", "valid_from", "valid_to", "sys_time", "correction"], f[2:])))
        said.append(d)
    assert said == ["first_seen", "duplicate", "support", "state_transition", "conflict", "conflict", "correction", "needs_review"]
    past = bitemporal.as_of(spark.createDataFrame(out), F.lit(15), F.lit(100)).collect()
    assert [r["value"] for r in past] == ["a"]


def test_correlation_clustering(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.1), (10, 11, 0.95), (11, 12, 0.95), (10, 12, 0.95), (12, 20, 0.51), (20, 21, 0.9), (20, 22, 0.9), (21, 22, 0.9)]
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 11, 12, 20, 21, 22, 99)], "node long")
    got = {r["node"]: r["cluster"] for r in resolution.correlation_clusters(nodes, spark.createDataFrame(edges, "a long, b long, p double")).collect()}
    assert got[99] == 99 and got[10] == got[11] == got[12] == 10 and got[21] == got[22] and got[2] in (got[1], got[3])


def test_components_and_redirects(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 20)], "node long, target long")
    assert {r["target"] for r in graph.follow_redirects(chain).collect()} == {0}


def test_band_join_meets_every_pair(spark):
    a = [(i, "k", (i * 37) % 500 - 250) for i in range(60)]
    left = spark.createDataFrame(a, "a long, k string, x long")
    right = spark.createDataFrame([(i, k, x + 3) for i, k, x in a], "b long, k string, y long")
    got = {(r["a"], r["b"]) for r in joins.band_join(left, right, ["k"], "x", "y", 10).collect()}
    assert got == {(i, j) for i, _, x in a for j, _, y in a if abs(x - y - 3) <= 10}


def test_salted_top_k(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id")).repartition(7)
    assert [r["id"] for r in joins.top_k_salted(df, ["g"], [F.desc("id")], 3).orderBy("rn").collect()] == [999, 998, 997]


def test_writers(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    b = spark.createDataFrame([(2, "c", 5), (2, "d", 4), (3, "e", 1)], "k int, v string, seq int")
    assert sorted((r["k"], r["v"]) for r in merge.insert_ignore(t, b, ["k"], ["seq"]).collect()) == [(1, "a"), (2, "b"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in merge.insert_replace(t, b, ["k"], ["seq"]).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_metrics(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 0.5), (True, 1.0), (False, 0.1), (True, None)], "y boolean, s double")
    assert evaluation.auroc(df, "y", "s").first()[0] == pytest.approx(0.875)
    assert evaluation.auroc(df.filter("y"), "y", "s").first()[0] is None
    assert tuple(evaluation.best_threshold(df, "y", "s").first()) == (0.75, 0.5)
    assert {r["bin"] for r in evaluation.reliability(df, "y", "s").collect()} == {1, 5, 9}
    assert one(spark, metrics.ensemble([metrics.logit(F.lit(0.9)), metrics.logit(F.lit(0.9))], [1.0, 2.0], 1.0)) == pytest.approx(0.9)


def test_decision_cascade(spark):
    say = lambda **k: one(spark, resolution.decision(*(F.lit(k.get(n, d)) for n, d in [("n", 5), ("anchor", None), ("cands", 1), ("score", 0.8), ("kind", True), ("entity", 0.6), ("overlap", True), ("cover", True)])))
    assert [say(n=0), say(anchor="x"), say(cands=0), say(cands=0, cover=False), say(score=0.9), say(score=0.5), say(cover=False), say()] == ["create_empty", "attach_anchor", "create_none", "pending", "attach_bypass", "create_low", "pending", "judge"]


def test_corpus_scan_quarantines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"url": "u1", "content": "x"}, {"url": "u2"}]')
    (tmp_path / "b.json").write_text('{"items": [{"url": "u3"}]}')
    (tmp_path / "c.json").write_text("{broken")
    items, bad = files.read_corpus(spark, [f"file://{tmp_path}"])
    assert sorted(r["url"] for r in items.collect()) == ["u1", "u2", "u3"] and bad.count() == 1


def test_retry_delays(spark):
    assert [one(spark, streams.backoff_seconds(F.lit(n))) for n in (1, 3, 6, 9)] == [2, 8, 64, 64]


def test_stream_and_batch_folds_agree(spark, sf_dir):
    from evoria import catalog

    q = catalog.queries()
    assert sorted(map(tuple, q["M07_stream_slot_state"](spark, sf_dir).collect())) == sorted(map(tuple, q["A05_slot_decisions"](spark, sf_dir).collect()))
