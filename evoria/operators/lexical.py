"""BM25 over postings, rank fusion, rerank aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .graph import store

K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, body: Column, terms: DataFrame | None = None) -> DataFrame:
    """``key, term, tf, dl``; with ``terms(term)`` only those terms leave the scan."""
    rows = docs.select(key, text.tokenize(body).alias("w")).withColumn("dl", F.size("w")).select(key, "dl", F.explode("w").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


#: Scores that a task holds at once.
MOST_SCORES = 1 << 21


def bm25(docs: DataFrame, queries: DataFrame, key: str, body: Column, query_key: str, query: Column) -> DataFrame:
    """``query_key, key, score`` of all documents that share a term with the query (a set of terms), scores above 0.

    Documents without a token count in N and in the mean length. The query set travels to every task, so a document is
    counted and scored where it is read: neither its words nor its scores are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    asked = queries.select(F.col(query_key).alias("item"), F.explode(F.array_distinct(text.tokenize(query))).alias("term")).distinct().toArrow()
    whole = lambda c: pa.concat_arrays([*asked[c].chunks, pa.array([], asked[c].type)]).dictionary_encode("encode")
    items, terms = whole("item"), whole("term")
    items, terms, item_of, term_of = items.dictionary, terms.dictionary, items.indices.to_numpy(), terms.indices.to_numpy()
    dealt = (items, item_of[np.argsort(term_of, kind="stable")], np.cumsum(np.bincount(term_of, minlength=len(terms))))

    # texts are cut into words once: the stored counts of the asked terms give the statistics and the scores
    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(key, text.tokenize(body).alias("w"))
    rows = store(cut.mapInArrow(lambda batches: (count_terms(b, terms) for b in batches), f"`{key}` {kind}, dl int, terms array<int>, tf array<int>"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    rows = rows.filter(F.size("terms") > 0)
    twice = not rows.groupBy(key).count().filter("count > 1").isEmpty()
    if twice:
        # rows of one id and length are one document, as in the SQL
        each = rows.select(key, "dl", F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy(key, "dl", "x.terms").agg(F.sum("x.tf").cast("int").alias("tf"))
        rows = store(each.groupBy(key, "dl").agg(F.collect_list(F.struct("terms", "tf")).alias("x")).select(key, "dl", F.col("x.terms").alias("terms"), F.col("x.tf").alias("tf")))
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row of statistics, and one row for each asked term
    idf = df.join(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl").toArrow()
    weight = np.zeros(len(terms))
    weight[idf["term"].to_numpy()] = idf["idf"].to_numpy()
    avgdl = idf["avgdl"][0].as_py() if len(idf) else 1.0

    scores = rows.mapInArrow(lambda batches: (x for b in batches for x in score_terms(b, dealt, weight, avgdl)), f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {kind}, score double")
    if twice:
        scores = scores.groupBy(query_key, key).agg(F.sum("score").alias("score"))
    return scores.withColumn("score", F.round("score", 6)).filter("score > 0")


def count_terms(batch, terms):
    """Of each row ``key, w``: its key, the number of its words, the places of its words in ``terms`` and how often they occur."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = pc.fill_null(pc.index_in(pc.list_flatten(batch.column(1)), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    seen, n = np.unique((row * max(len(terms), 1) + place)[place >= 0], return_counts=True)
    offsets = pa.array(np.searchsorted(seen, np.arange(len(size) + 1) * max(len(terms), 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (seen % max(len(terms), 1), n)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), *lists], [batch.schema.names[0], "dl", "terms", "tf"])


def score_terms(batch, asked, weight, avgdl):
    """Batches ``query_key, key, score`` of rows ``key, dl, terms, tf``; ``asked``: the queries, those of every term in a row, and where they end."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    items, of_items, ends = asked
    starts = ends - np.diff(np.r_[0, ends])
    keys, tf = batch.column(0), pc.list_flatten(batch.column(3)).to_numpy()
    size, term = pc.list_value_length(batch.column(2)).to_numpy(), pc.list_flatten(batch.column(2)).to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    dl = batch.column(1).to_numpy()[row]
    part = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    n = ends[term] - starts[term]
    step = max(1, MOST_SCORES // max(len(items), 1))
    for low in range(0, len(size), step):
        a, b = np.searchsorted(row, [low, low + step])
        m = n[a:b]
        at = np.arange(m.sum()) + np.repeat(starts[term[a:b]] - (np.cumsum(m) - m), m)
        code = np.repeat(row[a:b] - low, m) * len(items) + of_items[at]
        score = np.bincount(code, np.repeat(part[a:b], m))
        hit = np.flatnonzero(score)
        yield pa.RecordBatch.from_arrays([items.take(pa.array(hit % len(items))), keys.take(pa.array(hit // len(items) + low)), pa.array(score[hit])], ["item", "key", "score"])


def top(scores: DataFrame, group: str, key: str, k: int, score: str = "score") -> DataFrame:
    return scores.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).filter(F.col("rn") <= k)


def normalized_by_max(scores: DataFrame, group: str, score: str = "score") -> DataFrame:
    """``share`` of the best score of the group; the best ones of all groups (a query set) travel to the scores, which stay where they are."""
    best = scores.groupBy(F.col(group).alias("_group")).agg(F.max(score).alias("_best"))
    return scores.join(F.broadcast(best), F.col(group).eqNullSafe(F.col("_group"))).withColumn("share", F.col(score) / F.col("_best")).drop("_group", "_best")


def rrf(channels: list[DataFrame], group: str, key: str, k: int = RRF_K) -> DataFrame:
    """``group, key, fused`` from channels(group, key, rn with 1 for the best): sum of 1 / (k + rn), each channel's best rank once."""
    ranked = [c.groupBy(group, key).agg(F.min("rn").alias("rn")) for c in channels]
    both = ranked[0]
    for c in ranked[1:]:
        both = both.unionByName(c)
    return both.groupBy(group, key).agg(F.sum(1.0 / (k + F.col("rn"))).alias("fused"))


def chunk_max(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """A document's rerank score is that of its best chunk."""
    return scores.groupBy(*keys).agg(F.max(score).alias(score))


def index_text(kind: str, **columns: Column) -> Column:
    """What an index reads: a cluster's summary and frame, a document's title, source and first 4,000 characters, or an event card."""
    if kind == "document":
        return F.concat_ws(" ", columns["title"], columns["source"], F.substring(columns["body"], 1, 4000))
    if kind == "cluster":
        return F.concat_ws(" ", columns["summary"], columns["frame"])
    return F.concat_ws(" ", *columns.values())


def choice_rank(answers: DataFrame, group: str, key: str, mass: str) -> DataFrame:
    """Rank by a judge's choice distribution; the mass of "none of them" (a null key) stays out and is not shared out again."""
    return top(answers.filter(F.col(key).isNotNull()), group, key, 1 << 30, mass)
