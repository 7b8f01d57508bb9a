"""Property graph: listings, aggregates, neighbourhoods, components, edits with optimistic locks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import top_k

#: Spark's setting that shuffle files go at the end of an execution.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder of our own where it is unset and all runs on this host.

    Without it on a cluster every executor would write to its own disk: that is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="evoria-"))
        path = _own[0]
    return path.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage for loops, and survives lost executors.

    Spark may drop the shuffle files of the write as soon as it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evoria/{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Removes what this engine has written under the shared folder; DataFrames that read it are void then."""
    jvm, path = spark._jvm, f"{shared_folder(spark)}/evoria"
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of edges(src, dst) without self-loops."""
    e = edges.filter("src <> dst").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def neighbourhood(edges: DataFrame, focus: DataFrame, hops: int, most: int | None = None) -> DataFrame:
    """``node, hop``: nodes within ``hops`` steps of focus(node), in either direction; with ``most``, those of the highest degree among them (the focus always stays).

    Each hop is one join of the frontier with the edges; visited nodes are left out of the next frontier.
    """
    both = undirected(edges)
    seen = focus.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        step = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    if most is None:
        return seen
    inside = degrees(induced(edges, seen))
    ranked = seen.join(inside, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return ranked.orderBy((F.col("hop") > 0), F.desc("degree"), "node").limit(most).select("node", "hop")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` (smallest node reachable) for the ends of edges(a, b).

    Two steps in turn: every node hands its least neighbour to its larger ones, then to itself and its smaller ones, so
    paths shrink and a hub's edges move to its root. The number of edges never grows; aggregation on a hub's key is
    partial before the shuffle. Rounds are stored; a count and a checksum of each reach the driver.
    """

    def hand_over(pairs: DataFrame, upward: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        moved = (both.filter("b > a") if upward else both).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        return (moved if upward else moved.union(own)).filter("a <> b").distinct()

    state, last = store(edges.filter("a <> b").select("a", "b").distinct()), None
    for _ in range(rounds):
        state = store(hand_over(hand_over(state, True), False))
        now = tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select("b", "b").distinct())
        last = now
    raise RuntimeError("components did not settle")


def aggregate_by(facts: DataFrame, node: str, event: str, kind: str, at: str, k: int, kinds: int = 3) -> DataFrame:
    """Top nodes by distinct events: bounds in time and a map of their most frequent kinds."""
    base = facts.groupBy(node).agg(F.count_distinct(event).alias("events"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    per = facts.groupBy(node, kind).agg(F.count_distinct(event).alias("n"))
    best = top_k(per, [node], [F.desc("n"), kind], kinds).groupBy(node).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rn", kind, "n"))), lambda x: F.struct(x[kind], x["n"]))).alias("kinds"))
    return base.join(best, node).orderBy(F.desc("events"), node).limit(k)


def add_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """New edges (src, dst, relation) without self-loops; a deleted edge that comes again lives again, others stay."""
    new = batch.filter("src <> dst").select("src", "dst", "relation").distinct().withColumn("_again", F.lit(True))
    joined = edges.join(new, ["src", "dst", "relation"], "full")
    return joined.select("src", "dst", "relation", F.when(F.col("_again"), F.lit(None)).otherwise(F.col("deleted_at")).alias("deleted_at"))


def locked_update(snapshot: DataFrame, commands: DataFrame, key: str, version: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rejects): a command applies if its key exists and its expected version is the current one (or null).

    Rejects carry a code: 404 without such a key, 409 for another version. Commands hold one row for a key.
    """
    c = commands.select(key, "expected", *(F.col(x).alias(f"_new_{x}") for x in columns), F.lit(True).alias("_asked"))
    current = snapshot.join(c, key, "left")
    ok = F.coalesce(F.col("_asked") & (F.col("expected").isNull() | (F.col("expected") == F.col(version))), F.lit(False))
    new = current.select(*((F.when(ok, F.coalesce(f"_new_{x}", x)).otherwise(F.col(x)).alias(x) if x in columns else (F.col(x) + ok.cast("int")).alias(x) if x == version else F.col(x)) for x in snapshot.columns))
    rejects = commands.join(snapshot.select(key, F.col(version).alias("_now")), key, "left").withColumn("code", F.when(F.col("_now").isNull(), 404).when(F.col("expected") != F.col("_now"), 409)).filter("code IS NOT NULL").select(key, "code")
    return new, rejects


def move_members(members: DataFrame, moves: DataFrame, member: str, cluster: str, stamp: Column) -> DataFrame:
    """Membership rows after moves(member, target): the old row gets a tombstone, a new one is added."""
    m = moves.select(member, F.col("target").alias("_to"))
    marked = members.join(m, member, "left")
    closed = marked.withColumn("removed_at", F.when(F.col("_to").isNotNull() & F.col("removed_at").isNull() & (F.col("_to") != F.col(cluster)), stamp).otherwise(F.col("removed_at"))).drop("_to")
    added = marked.filter(F.col("_to").isNotNull() & F.col("removed_at").isNull() & (F.col("_to") != F.col(cluster))).select(*((F.col("_to").alias(cluster) if x == cluster else F.lit(None).cast(members.schema[x].dataType).alias(x) if x == "removed_at" else F.col(x)) for x in members.columns))
    return closed.select(*members.columns).unionByName(added)


def split(members: DataFrame, request: DataFrame, member: str, cluster: str) -> tuple[DataFrame, DataFrame]:
    """(memberships, rejects) for request(cluster, member): the listed members move to a new cluster (their smallest member).

    A request must name a proper, non-empty subset of the cluster's members; others are rejected with 400.
    """
    size = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_all"))
    asked = request.groupBy(cluster).agg(F.count(F.lit(1)).alias("_asked"))
    inside = request.join(members, [cluster, member]).groupBy(cluster).agg(F.count(F.lit(1)).alias("_in"), F.min(member).alias("_new"))
    verdict = asked.join(inside, cluster, "left").join(size, cluster, "left")
    ok = (F.col("_in") == F.col("_asked")) & (F.col("_in") < F.col("_all"))
    good = verdict.filter(ok).select(cluster, "_new")
    moved = request.select(cluster, member).join(good, cluster)
    out = members.join(moved, [cluster, member], "left").select(*((F.coalesce("_new", cluster).alias(cluster) if c == cluster else F.col(c)) for c in members.columns))
    return out, verdict.filter(~F.coalesce(ok, F.lit(False))).select(cluster, F.lit(400).alias("code"))


def follow_redirects(redirects: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, target`` where every chain of redirects(node, target) ends; pointers double each round."""
    now = store(redirects.select("node", "target"))
    for _ in range(rounds):
        nxt = now.select(F.col("node").alias("target"), F.col("target").alias("further"))
        step = store(now.join(nxt, "target", "left").select("node", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        if not step.filter("moved AND node <> target").limit(1).count():
            return step.select("node", "target")
        now = step.select("node", "target")
    raise ValueError("redirects form a cycle")


def merge(members: DataFrame, edges: DataFrame, redirects: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """Members and edges of redirected clusters under their targets; edges that become loops or repeat go."""
    end = store(follow_redirects(redirects))
    at = lambda df, c: df.join(end.select(F.col("node").alias(c), F.col("target").alias("_t")), c, "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
    return at(members, cluster).select(*members.columns), at(at(edges, "src"), "dst").select(*edges.columns).filter("src <> dst").distinct()
