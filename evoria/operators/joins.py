"""Join recipes: time bands by buckets, interval overlap, pairs without a common key, top rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, gap: int) -> DataFrame:
    """Rows with equal ``keys`` and ``abs(left_at - right_at) <= gap`` (integers), as an equi-join on buckets of ``gap``.

    The left side visits the bucket before, its own and the one after, so no pair is compared outside its bucket. The
    right side's columns must have other names than the left's but for ``keys``.
    """
    here = F.floor(F.col(left_at) / gap)
    l = left.withColumn("_bucket", F.explode(F.array(here - 1, here, here + 1)))
    r = right.withColumn("_bucket", F.floor(F.col(right_at) / gap))
    return l.join(r, [*keys, "_bucket"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= gap).drop("_bucket")


def overlap(lower_a: Column, upper_a: Column, lower_b: Column, upper_b: Column) -> Column:
    """Closed intervals meet; null bounds never do."""
    return (lower_a <= upper_b) & (lower_b <= upper_a)


def half_open_overlap(lower_a: Column, upper_a: Column, lower_b: Column, upper_b: Column) -> Column:
    return (lower_a < upper_b) & (lower_b < upper_a)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of every group under a total order (a group limit before the shuffle)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def top_k_salted(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, salts: int = 32, rank: str = "rn") -> DataFrame:
    """``top_k`` for hot groups: first inside salted parts of a group, then over the survivors."""
    parts = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    kept = top_k(parts, [*keys, "_salt"], order, k, "_part_rank").drop("_salt", "_part_rank")
    return top_k(kept, keys, order, k, rank)


#: Rows of a table that may travel to every task.
MOST_CARRIED = 5_000_000


def pairs_without_shared(items: DataFrame, uses: DataFrame, item: str, group: str, user: str, thing: str) -> DataFrame:
    """``a, b``: pairs a < b of ``items(item, group)`` of one group that have no thing of ``uses(user, thing)`` in common.

    The pairs are as many as the squares of the groups, so they are never shuffled or sorted: every item holds its
    partners with a thing in common, is dealt by its id, and meets its group as a stream. Only things that two items
    of one group share are looked at.
    """
    used = uses.join(items.select(F.col(item).alias(user), group), user).select(user, group, thing).distinct()
    both = used.withColumnRenamed(user, "a").join(used.withColumnRenamed(user, "b"), [thing, group]).filter("a < b")
    shared = both.select("a", "b").repartition("a").distinct().groupBy("a").agg(F.collect_list("b").alias("_shared"))
    n = items.count()
    left = items.select(F.col(item).alias("a"), group).join(shared, "a", "left").repartition(n // 1000 + 32, "a")
    right = items.select(F.col(item).alias("b"), group)
    pairs = left.join(F.broadcast(right) if n <= MOST_CARRIED else right, group).filter("a < b")
    return pairs.filter(~F.coalesce(F.array_contains("_shared", F.col("b")), F.lit(False))).select("a", "b")


def incident(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """Edges with either end among ``nodes``: two semi-joins instead of an OR condition."""
    by_src = edges.join(nodes, edges[src] == nodes[node], "left_semi")
    by_dst = edges.join(nodes, edges[dst] == nodes[node], "left_semi")
    return by_src.union(by_dst).distinct()


def seeded_order(key: str, seed: str) -> Column:
    """A reproducible random order: sha-256 of the key and a seed."""
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"), 256)
