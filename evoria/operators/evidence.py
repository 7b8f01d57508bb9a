"""Query layer: analysis, timelines, event retrieval, evidence packs, dashboards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times
from .joins import top_k


def analyze(queries: DataFrame, query: str, now: Column) -> DataFrame:
    """Adds ``intent, window_from, window_to``: a relative window, else the date that the text names, up to ``now``."""
    q = F.col(query)
    start = F.coalesce(times.relative_window(q, now).cast("timestamp"), times.query_date(q))
    return queries.withColumns({"intent": text.intent(q), "window_from": start, "window_to": F.when(start.isNotNull(), now)})


def timeline(events: DataFrame, members: DataFrame, event: str, at: str, limit: int) -> DataFrame:
    """Events in time order (unknown times last) with their member counts."""
    counts = members.groupBy(event).agg(F.count(F.lit(1)).alias("members"))
    return events.join(counts, event, "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long"))).orderBy(F.col(at).asc_nulls_last(), event).limit(limit)


def retrieve(channels: list[tuple[DataFrame, int]], query: str, event: str, boost: DataFrame, bonus: float = 0.15, loaded: int = 300, scored: int = 60, k: int = 12) -> DataFrame:
    """Channels (query, event, rn) one after another, each cut to its limit; the first ``scored`` events ranked.

    ``boost(query, event, relevance, decay, entity_hit)``: score = relevance (0.5 if unknown) * decay + bonus for entity hits.
    """
    parts = [c.filter(F.col("rn") <= limit).select(query, event, F.lit(i).alias("channel"), "rn") for i, (c, limit) in enumerate(channels)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = both.groupBy(query, event).agg(F.min(F.struct("channel", "rn")).alias("x"))
    pool = first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("x.channel", "x.rn", event))).filter(F.col("place") <= min(loaded, scored))
    score = F.coalesce("relevance", F.lit(0.5)) * F.coalesce("decay", F.lit(1.0)) + F.when(F.col("entity_hit"), bonus).otherwise(0.0)
    ranked = pool.join(boost, [query, event], "left").withColumn("score", F.round(score, 6))
    return top_k(ranked, [query], [F.desc("score"), event], k).select(query, event, "score", "rn")


def gateway(events: DataFrame, members: DataFrame, event: str, member: str, lineage: str, order: list, per_event: int = 8) -> DataFrame:
    """At most ``per_event`` members of each event, one of a lineage group."""
    w = Window.partitionBy(event, lineage).orderBy(*order)
    own = members.join(events.select(event).distinct(), event, "left_semi").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return top_k(own, [event], order, per_event)


def pack(parent: DataFrame, children: Mapping[str, tuple[DataFrame, list[str], int]], key: str) -> DataFrame:
    """``parent`` with an array of structs of each child table, ordered by the child's first columns and cut."""
    out = parent
    for name, (child, columns, most) in children.items():
        listed = child.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(*columns))), 1, most).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out


def render(packed: DataFrame, key: str) -> DataFrame:
    """``key, prompt``: the pack as JSON."""
    return packed.select(key, F.to_json(F.struct(*[c for c in packed.columns if c != key])).alias("prompt"))


def counts(tables: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One row of dashboard counts: (name, n) of each table under its condition."""
    parts = [df.agg(F.lit(name).alias("name"), (F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias("n")) for name, (df, cond) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tail(events: DataFrame, cursor: int, limit: int, where: Column | None = None, key: str = "event_id") -> DataFrame:
    """Rows after a cursor, newest first."""
    rows = events.filter(F.col(key) > cursor)
    return (rows if where is None else rows.filter(where)).orderBy(F.desc(key)).limit(limit)
