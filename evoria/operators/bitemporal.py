"""Bitemporal facts: slots, decisions, selections over valid and system time, point queries and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids

#: Scope entries that are no part of a slot.
NOT_SCOPE = ("business_no",)


def scope_key(scope: Column) -> Column:
    """Sorted k=v pairs joined by a pipe, without empty values."""
    kept = F.map_filter(scope, lambda k, v: ~k.isin(*NOT_SCOPE) & (F.coalesce(v, F.lit("")) != ""))
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def slot_key(subject: Column, predicate: Column, scope: Column) -> Column:
    return F.concat(subject, F.lit(":"), predicate, F.lit(":"), F.coalesce(scope_key(scope), F.lit("")))


def assertion_id(slot: Column, value: Column, valid_from: Column, version: Column) -> Column:
    return ids.uuid5("assert", slot, value, F.coalesce(valid_from, F.lit("")), version)


def claim_subject(predicate: Column, product_predicates: Sequence[str], actors: Column, objects: Column) -> Column:
    """Product predicates speak of the first object; others of the first actor, or of an object where there is none."""
    first = lambda a: F.get(a, F.lit(0))
    return F.when(predicate.isin(*product_predicates), F.coalesce(first(objects), first(actors))).otherwise(F.coalesce(first(actors), first(objects)))


def open_intervals(facts: DataFrame, slot: str, at: str, order: Sequence[str]) -> DataFrame:
    """Adds ``valid_to``: the next start in the slot, null for the open one."""
    return facts.withColumn("valid_to", F.lead(at).over(Window.partitionBy(slot).orderBy(at, *order)))


def as_of(selections: DataFrame, valid_at: Column, known_at: Column, slot: str = "slot", limit: int = 5) -> DataFrame:
    """Selections of each slot valid at one time as known at another (half-open on both axes), newest knowledge first."""
    inside = lambda lo, hi, t: (F.col(lo) <= t) & (F.col(hi).isNull() | (F.col(hi) > t))
    hit = selections.filter(inside("valid_from", "valid_to", valid_at) & inside("sys_from", "sys_to", known_at))
    return hit.withColumn("rn", F.row_number().over(Window.partitionBy(slot).orderBy(F.desc("sys_from"), F.desc("valid_from")))).filter(F.col("rn") <= limit)


def as_of_join(probes: DataFrame, facts: DataFrame, keys: Sequence[str], probe_at: str, fact_at: str, tiebreak: str, value: Sequence[str]) -> DataFrame:
    """Every probe with the last fact of its key at or before its time (null if none).

    One union and one window: facts and probes meet sorted by time, and the last fact is carried forward. A hot key is
    still one sort; the join has no pairs of probes and facts.
    """
    packed = F.struct(*(F.col(v) for v in value))
    f = facts.select(*keys, F.col(fact_at).alias("_at"), F.lit(0).alias("_kind"), F.col(tiebreak).cast("string").alias("_tie"), packed.alias("_fact"), F.lit(None).cast(probes.schema).alias("_probe"))
    p = probes.select(*keys, F.col(probe_at).alias("_at"), F.lit(1).alias("_kind"), F.lit("").alias("_tie"), F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"), F.struct(*probes.columns).alias("_probe"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = f.unionByName(p).withColumn("_last", F.last("_fact", ignorenulls=True).over(order)).filter("_kind = 1")
    return joined.select("_probe.*", *(F.col(f"_last.{v}").alias(f"fact_{v}") for v in value))


def decide_by_predecessor(facts: DataFrame, slot: str, order: Sequence[str], value: str, lineage: str, valid_from: str) -> DataFrame:
    """Adds ``decision`` against the fact just before in the slot: one window, no state."""
    w = Window.partitionBy(slot).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    d = F.when(F.row_number().over(w) == 1, "first_seen")
    d = d.when(F.col(value).eqNullSafe(before(value)), F.when(F.col(lineage).eqNullSafe(before(lineage)), "duplicate").otherwise("support"))
    d = d.when(F.col(valid_from).isNull() | before(valid_from).isNull(), "needs_review").when(F.col(valid_from) > before(valid_from), "state_transition").when(F.col(valid_from) == before(valid_from), "conflict")
    return facts.withColumn("decision", d.otherwise("needs_review"))


def step(state: dict[str, Any] | None, fact: dict[str, Any]) -> tuple[dict[str, Any], str, list[dict[str, Any]]]:
    """One fact against a slot's state: (new state, decision, selections to write).

    State: ``prior`` (the latest accepted-for-comparison fact) and ``open`` (the selection that holds now). Selections
    are rows over valid and system time; ``op`` says close (of the open row) or open. A fact that is set aside still
    becomes the prior of the next one. A state transition closes the belief and states the old value again for the
    time in which it was valid, so the past stays known.
    """
    state = state or {"prior": None, "open": None}
    prior, now, writes = state["prior"], fact["sys_time"], []

    def close():
        if state["open"] is not None:
            writes.append({"op": "close", **state["open"], "sys_to": now})

    def open_row(value, lo, hi, disposition, current=True):
        row = {"value": value, "valid_from": lo, "valid_to": hi, "sys_from": now, "disposition": disposition}
        writes.append({"op": "open", **row, "sys_to": None})
        return row if current else None

    opened = state["open"]
    vf = fact["valid_from"]
    if prior is None:
        decision, opened = "first_seen", open_row(fact["value"], vf, fact["valid_to"], "accepted")
    elif fact["value"] == prior["value"]:
        decision = "duplicate" if fact["lineage"] == prior["lineage"] else "support"
    elif fact["correction"]:
        decision = "correction"
        close()
        opened = open_row(fact["value"], prior["valid_from"] if vf is None else vf, fact["valid_to"], "accepted")
    elif vf is None or prior["valid_from"] is None or vf < prior["valid_from"]:
        decision = "needs_review"
    elif vf > prior["valid_from"]:
        decision = "state_transition"
        close()
        if state["open"] is not None:
            open_row(state["open"]["value"], state["open"]["valid_from"], vf, state["open"]["disposition"], current=False)
        opened = open_row(fact["value"], vf, fact["valid_to"], "accepted")
    elif fact["valid_to"] is not None and prior["valid_to"] is not None and prior["valid_to"] >= fact["valid_to"]:
        decision = "needs_review"
    else:
        decision = "conflict"
        close()
        opened = open_row(f"{prior['value']} | {fact['value']}", vf, None, "conflicted")
    return {"prior": fact, "open": opened}, decision, writes


def fold(facts: DataFrame, slot: str, order: Sequence[str]) -> DataFrame:
    """All selections of every slot after its facts in order: (slot, value, valid_from, valid_to, sys_from, sys_to, disposition, decision).

    ``facts`` has value, lineage (strings), valid_from, valid_to, sys_time (longs) and correction (boolean). Slots are
    dealt over tasks and come sorted, so a task holds the state of one slot and the row that is open in it.
    """
    names = ["value", "lineage", "valid_from", "valid_to", "sys_time", "correction"]
    times = ["valid_from", "valid_to", "sys_from", "sys_to"]
    columns = [slot, "value", *times, "disposition", "decision"]

    def run(batches):
        import pandas as pd

        def made(rows):
            out = pd.DataFrame(rows, columns=columns)
            return out.astype({c: "Int64" for c in times})

        now, state, current, started = None, None, None, False
        for batch in batches:
            rows = []
            plain = batch[[slot, *names]].astype(object)
            for record in plain.where(plain.notna(), None).to_dict("records"):
                if not started or record[slot] != now:
                    if current is not None:
                        rows.append(current)
                    now, state, current, started = record[slot], None, None, True
                state, decision, writes = step(state, {n: record[n] for n in names})
                for w in writes:
                    if w["op"] == "close":
                        rows.append(current | {"sys_to": w["sys_to"]})
                        current = None
                        continue
                    if current is not None:  # a restated past: stands open beside the row that follows
                        rows.append(current)
                    current = {slot: now, "decision": decision} | {k: w[k] for k in ("value", *times, "disposition")}
            if rows:
                yield made(rows)
        if current is not None:
            yield made([current])

    kind = facts.schema[slot].dataType.simpleString()
    ordered = facts.select(slot, *names, *(c for c in order if c not in (slot, *names))).repartition(slot).sortWithinPartitions(slot, *order)
    return ordered.mapInPandas(run, f"`{slot}` {kind}, value string, valid_from long, valid_to long, sys_from long, sys_to long, disposition string, decision string")


def change_cards(decided: DataFrame, slot: str, predicate: str, watched: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(slot, kind, before, after, dedupe_key) for transitions of watched predicates, and for every conflict."""
    w = Window.partitionBy(slot).orderBy(*order)
    rows = decided.withColumn("before", F.lag(value).over(w)).filter(((F.col("decision") == "state_transition") & F.col(predicate).isin(*watched)) | (F.col("decision") == "conflict"))
    keyed = rows.select(slot, F.col("decision").alias("kind"), "before", F.col(value).alias("after"), *order)
    return keyed.withColumn("dedupe_key", ids.short_hash(F.concat_ws(ids.SEPARATOR, *(F.col(c).cast("string") for c in (slot, "kind", "before", "after"))))).dropDuplicates(["dedupe_key"])


def retract(assertions: DataFrame, selections: DataFrame, gone: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Assertions marked retracted, and the open selections that chose them closed at ``now``."""
    mark = gone.select("assertion_id").distinct().withColumn("_gone", F.lit(True))
    a = assertions.join(mark, "assertion_id", "left").withColumn("status", F.when(F.col("_gone"), "retracted").otherwise(F.col("status"))).drop("_gone")
    s = selections.join(mark, "assertion_id", "left").withColumn("sys_to", F.when(F.col("_gone") & F.col("sys_to").isNull(), now).otherwise(F.col("sys_to"))).drop("_gone")
    return a, s


def evidence_rows(assertions: DataFrame, key: str, quotes: str, most: int = 3) -> DataFrame:
    return assertions.select(key, F.posexplode(F.slice(quotes, 1, most)).alias("evidence_no", "quote"))
