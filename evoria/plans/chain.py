"""The operators in a row: documents in, facts as of a day with their evidence out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitemporal, evidence, ingest
from .registry import query, table
from .text import _BODY


@query("X20_ingest_to_evidence_pack", f"""WITH a AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE length(text) >= 60),
live AS (SELECT doc_id, substr(sha256(substr({_BODY}, 1, 2000)), 1, 16) AS lineage_group FROM a WHERE first = doc_id),
m AS (SELECT event_id, user_id, user_id || ':' || event_type || ':' AS slot, floor(value / 25)::BIGINT AS v, ts, lineage_group FROM events JOIN live ON doc_id = event_id),
s AS (SELECT *, lead(ts) OVER (PARTITION BY slot ORDER BY ts, event_id) AS until FROM m),
f AS (SELECT user_id, slot, v, event_id, lineage_group FROM s WHERE ts <= TIMESTAMP '2024-01-15' AND (until IS NULL OR until > TIMESTAMP '2024-01-15')),
p AS (SELECT user_id, list(slot || '=' || v || '@' || lineage_group ORDER BY slot, event_id)[1:3] AS x FROM f GROUP BY 1)
SELECT user_id, coalesce(len(x), 0)::INTEGER AS n, coalesce(list_aggregate(x, 'string_agg', ';'), '') AS facts FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN p USING (user_id)""")
def ingest_to_pack(spark, d):
    # ingest: short texts are rejected, copies are marked, reprints share a lineage group
    accepted, _ = ingest.split_short(table(spark, d, "documents"), "text")
    originals = ingest.duplicates(accepted, "doc_id", F.col("text"), ["doc_id"]).filter("duplicate_of IS NULL")
    live = ingest.lineage(originals.select("doc_id", "text"), "doc_id", "text", ["doc_id"]).select(F.col("doc_id").alias("event_id"), "lineage_group")
    # facts: an event is claimed by the document of its number
    events = table(spark, d, "events")
    slot = bitemporal.slot_key(F.col("user_id").cast("string"), F.col("event_type"), F.create_map(F.lit("business_no"), F.lit("x")))
    facts = events.join(live, "event_id").select("event_id", "user_id", slot.alias("slot"), F.floor(F.col("value") / 25).alias("v"), F.col("ts").cast("timestamp").alias("valid_from"), "lineage_group")
    selections = bitemporal.open_intervals(facts, "slot", "valid_from", ["event_id"]).withColumns({"sys_from": F.col("valid_from"), "sys_to": F.col("valid_to")})
    # query: what was known on the 15th, packed for each user
    at = F.lit("2024-01-15").cast("timestamp")
    known = bitemporal.as_of(selections, at, at).select("user_id", "slot", "event_id", "v", "lineage_group")
    packed = evidence.pack(events.select("user_id").distinct(), {"facts": (known, ["slot", "event_id", "v", "lineage_group"], 3)}, "user_id")
    shown = F.transform("facts", lambda x: F.concat(x["slot"], F.lit("="), x["v"].cast("string"), F.lit("@"), x["lineage_group"]))
    return packed.select("user_id", F.size("facts").alias("n"), F.array_join(shown, ";").alias("facts"))
