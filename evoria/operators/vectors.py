"""Vectors: norms, cosine search, centroids, incremental upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import store


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalized; a zero vector stays as it is."""
    # the norm is the one row of an array: named outside, Spark would compute it anew for every component
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))), F.lit(0))


#: Queries or centers that travel to every task at once; more of them travel in blocks of so many.
MOST_ASKED = 10_000


def in_blocks(df: DataFrame, item: Column) -> DataFrame:
    """``all``: arrays of ``item``, in rows of about ``MOST_ASKED``; broadcast only where one row holds them all.

    Beyond that Spark chooses between a nested-loop and a cartesian join by their size.
    """
    n = df.count()
    if n <= MOST_ASKED:
        return F.broadcast(df.groupBy().agg(F.array_sort(F.collect_list(item)).alias("all")))
    block = F.pmod(F.monotonically_increasing_id(), F.lit(-(-n // MOST_ASKED)))
    return df.select(item.alias("item"), block.alias("block")).groupBy("block").agg(F.array_sort(F.collect_list("item")).alias("all")).select("all")


#: Queries that meet a part of the vectors at once, and most rows of such a part.
QUERY_BLOCK, MOST_PART = 1 << 15, 1 << 16
#: Scores that lie closer than this to the k-th may tie with it once they are rounded to 6 places.
NEAR_SCORE = 1e-6 + 1e-9


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, key, score, rn``: the k nearest of every query of a stated set (its own row excluded).

    Every part of the vectors meets every block of queries in one task, as two matrices: memory is bounded by their
    sizes, and only rows that can be among the k best of a query leave it. Their scores are summed in the order of the
    components, as SQL does, and rounded to 6 places before ranking; ties go to the smaller id. A vector that is null,
    holds a null or has another length than the query gives a null score, ranked last.
    """
    import pyarrow as pa

    n, asked = vectors.count(), queries.count()
    parts, blocks = max(min(64, n >> 10), n // MOST_PART + 1), asked // QUERY_BLOCK + 1
    kind = vectors.schema[key].dataType.simpleString()
    u = F.when(F.forall(vector, lambda x: x.isNotNull()), unit(doubles(F.col(vector))))
    rows = lambda df: df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), u.alias("u"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    q = rows(queries).select("*", dealt(blocks).alias("block")).select("*", every(parts).alias("part"))
    v = rows(vectors).select("*", dealt(parts).alias("part")).select("*", every(blocks).alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks().sort_by("id")
        found = best_of_part(left["id"], left["u"], right["id"], right["u"], k)
        return pa.table({"query_id": left["id"].take(found[0]), "id": right["id"].take(found[1]), "score": pa.array(found[2], pa.float64(), mask=found[3])})

    met = q.groupBy("part", "block").cogroup(v.groupBy("part", "block")).applyInArrow(meet, f"query_id {kind}, id {kind}, score double")
    scored = met.select("query_id", F.col("id").alias(key), F.round("score", 6).alias("score"))
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).filter(F.col("rn") <= k)


def best_of_part(query_ids, queries, ids, vectors, k: int):
    """Places of queries and of vectors, scores, and where these are null: all pairs that can be among a query's k best.

    ``ids`` are sorted. Of equal scores the k smallest ids stay.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    own, asked = (x.to_numpy(zero_copy_only=False) for x in (ids.combine_chunks(), query_ids.combine_chunks()))
    first, last = np.searchsorted(own, asked, "left"), np.searchsorted(own, asked, "right")
    lengths = lambda x: pc.fill_null(pc.list_value_length(x), -1).to_numpy().astype(np.int64)
    dim_q, dim_v = lengths(queries), lengths(vectors)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
    for d in np.unique(dim_q):
        qi, vi, void = np.flatnonzero(dim_q == d), np.flatnonzero(dim_v == d), np.flatnonzero(dim_v != d)
        if d < 0:
            vi, void = vi[:0], np.arange(len(own))
        else:
            matrix = lambda x, at: pc.list_flatten(x.take(pa.array(at))).to_numpy().reshape(len(at), d)
            x, y = matrix(queries, qi), matrix(vectors, vi)
            for at in range(0, len(qi), tile := max(1, (1 << 22) // max(len(vi), 1))):
                out.append(_best_of_tile(np, x[at : at + tile], y, qi[at : at + tile], vi, first, last, k))
        if len(void):
            # null scores count where fewer than k others are left here
            for i in qi:
                others = len(vi) - (np.searchsorted(vi, last[i]) - np.searchsorted(vi, first[i]))
                if others < k:
                    at = void[(void < first[i]) | (void >= last[i])][:k]
                    out.append((np.full(len(at), i), at, np.zeros(len(at)), np.ones(len(at), bool)))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _best_of_tile(np, x, y, qi, vi, first, last, k: int):
    score = x @ y.T
    score[np.isnan(score)] = np.inf
    for row, i in enumerate(qi):
        score[row, np.searchsorted(vi, first[i]) : np.searchsorted(vi, last[i])] = -np.inf
    least = np.partition(score, score.shape[1] - k, axis=1)[:, -k, None] if score.shape[1] > k else np.full((len(qi), 1), -np.inf)
    row, col = np.nonzero((score >= least - NEAR_SCORE) & (score > -np.inf))
    exact = np.zeros(len(row))
    for j in range(x.shape[1]):
        exact += x[row, j] * y[col, j]
    order = np.lexsort((col, -np.nan_to_num(exact, nan=np.inf), row))
    row, col, exact = row[order], col[order], exact[order]
    key = np.nan_to_num(exact, nan=np.inf)
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    kept = place < k
    return qi[row[kept]], vi[col[kept]], exact[kept], np.zeros(int(kept.sum()), bool)


def centroids(members: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``group, centroid``: mean of the members' vectors, normalized. Partial sums for each position meet in the shuffle."""
    flat = members.select(group, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    mean = flat.groupBy(group, "pos").agg(F.avg("x").alias("m"))
    ordered = mean.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("a"))
    return ordered.select(group, unit(F.transform("a", lambda x: x["m"])).alias("centroid"))


def one_per_lineage(members: DataFrame, group: str, lineage: str, order: list[str]) -> DataFrame:
    """The first member of every (group, lineage): reprints do not weigh on a centroid."""
    return members.withColumn("_n", F.row_number().over(Window.partitionBy(group, lineage).orderBy(*order))).filter("_n = 1").drop("_n")


def nearest(vectors: DataFrame, centers: DataFrame, key: str, vector: str, center: str, label: str, k: int = 1) -> DataFrame:
    """``key, label, score, rn``: the k nearest centers of each vector; the centers travel as array rows.

    Each block of centers gives its own k best; where there are several blocks, these meet in one more ranking.
    """
    # counted and gathered: computed once
    centers = store(centers.select(label, center))
    asked = in_blocks(centers, F.struct(F.col(label).alias("label"), F.col(center).alias("c")))
    own = vectors.select(key, unit(doubles(F.col(vector))).alias("v")).join(asked)
    scored = F.transform("all", lambda x: F.struct((-F.round(dot(x["c"], F.col("v")), 6)).alias("back"), x["label"].alias("label")))
    best = own.select(key, F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("place", "x"))
    found = best.select(key, F.col("x.label").alias(label), (-F.col("x.back")).alias("score"), (F.col("place") + 1).alias("rn"))
    if centers.count() <= MOST_ASKED:
        return found
    return found.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), label))).filter(F.col("rn") <= k)


def stale_vectors(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(owner, sub, text_hash) that the store lacks: what an incremental run has to embed."""
    return wanted.join(stored, ["owner", "sub", "text_hash"], "left_anti")


def checked_dimension(vectors: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(good, bad) by vector length."""
    ok = F.coalesce(F.size(vector) == dim, F.lit(False))
    return vectors.filter(ok), vectors.filter(~ok)


def deactivate(vectors: DataFrame, owners: DataFrame, owner: str = "owner") -> DataFrame:
    """``active`` false for the vectors of the listed owners."""
    gone = owners.select(owner).distinct().withColumn("_gone", F.lit(True))
    return vectors.join(gone, owner, "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def own_representatives(members: DataFrame, vectors: DataFrame, group: str, member: str, order: list[str], most: int = 5) -> DataFrame:
    """Representative vectors of a group: those of its own first members, not of the latest one."""
    w = Window.partitionBy(group).orderBy(*order)
    return members.withColumn("rep_no", F.row_number().over(w)).filter(F.col("rep_no") <= most).join(vectors, member)
