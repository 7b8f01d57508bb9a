"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import free_name, text_or_empty


def ring_owners(n_shards: int, virtual_nodes: int, ring_slots: int, seed: int = 0) -> list[int]:
    """The shard that owns each virtual node's slot of the ring, -1 where no virtual node stands."""
    if n_shards < 1 or virtual_nodes < 1 or n_shards * virtual_nodes > ring_slots:
        raise ValueError("need 1 <= n_shards * virtual_nodes <= ring_slots")
    owners = [-1] * ring_slots
    for shard in range(n_shards):
        for node in range(virtual_nodes):
            at = int.from_bytes(hashlib.sha256(f"{seed}/{shard}/{node}".encode()).digest()[:8], "big") % ring_slots
            while owners[at] >= 0:
                at = (at + 1) % ring_slots
            owners[at] = shard
    return owners


def clockwise(owners: list[int], slot: int) -> list[int]:
    """Distinct shards in the order in which a key at ``slot`` meets them."""
    seen: list[int] = []
    for step in range(len(owners)):
        shard = owners[(slot + step) % len(owners)]
        if shard >= 0 and shard not in seen:
            seen.append(shard)
    return seen


def plan_segments(counts: dict[int, int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, first place in shard) for every run of keys.

    Every shard may hold ``total // n`` keys, the first ``total % n`` shards one more. Keys stay at the first shard
    clockwise while it has room; keys of a full shard continue clockwise. Work is bounded by the ring, not the data.
    """
    total = sum(counts.values())
    room = [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]
    used = [0] * n_shards
    placed: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []

    def put(slot: int, first: int, want: int, shard: int) -> int:
        n = min(want, room[shard] - used[shard])
        if n:
            placed.append((slot, first, first + n, shard, used[shard]))
            used[shard] += n
        return n

    nearest, home = -1, [0] * len(owners)
    for step in range(2 * len(owners) - 1, -1, -1):
        if owners[step % len(owners)] >= 0:
            nearest = owners[step % len(owners)]
        home[step % len(owners)] = nearest
    for slot in sorted(counts):
        n = put(slot, 0, counts[slot], home[slot])
        if n < counts[slot]:
            over.append((slot, n, counts[slot]))
    for slot, first, end in over:
        for shard in clockwise(owners, slot):
            first += put(slot, first, end - first, shard)
            if first == end:
                break
    return placed


def shard_documents(df: DataFrame, *, n_shards: int = 8, virtual_nodes: int = 64, ring_slots: int = 4096, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds ``size text_crc32 law shard slot grown_shard ring_shard`` and drops ``text``.

    The law that holds is ``rows``: shard sizes differ by one row at most. ``slot`` counts from 0 without gaps in each
    shard. ``ring_shard`` is where the key would stand without the bound. A null text has size 1 and crc 0; a null key
    has its own place on the ring; repeated rows are separate rows, equal ones in any order; an empty table gives an
    empty result. Columns of the input that clash with the new ones are replaced.

    Only one count for each ring slot (``ring_slots``, a parameter) reaches the driver. Ranks are taken inside ring
    slots, so the largest sort holds about 1 / ring_slots of the rows; texts are reduced to size and checksum first.
    """
    spark = df.sparkSession
    owners = ring_owners(n_shards, virtual_nodes, ring_slots, seed)
    slot_of = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(ring_slots)).cast("int")
    counts = {r["s"]: r["n"] for r in df.select(slot_of.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = plan_segments(counts, owners, n_shards)
    firsts = [clockwise(owners, s)[0] for s in range(ring_slots)]
    rows = [{"s": s, "a": a, "b": b, "h": h, "p": p, "r": firsts[s]} for s, a, b, h, p in segments]
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<s:int,a:bigint,b:bigint,h:int,p:bigint,r:int>>")).alias("x")).select("x.*")
    body = text_or_empty(text)
    new = {"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(body.cast("binary"))}
    keep = [c for c in df.columns if c.lower() not in {text.lower(), "size", "text_crc32", "law", "shard", "slot", "grown_shard", "ring_shard"}]
    at, rank = free_name(df, "_ring_slot"), free_name(df, "_ring_rank")
    sized = df.select(*keep, *(v.alias(k) for k, v in new.items()), slot_of.alias(at))
    order = Window.partitionBy(at).orderBy(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("text_crc32"), F.col("size")), F.col(key), "text_crc32", "size")
    ranked = sized.withColumn(rank, F.row_number().over(order).cast("long") - 1)
    # one row for each ring slot and split: at most ring_slots + n_shards ** 2 rows, whatever the data
    joined = ranked.join(F.broadcast(plan), (F.col(at) == plan["s"]) & (F.col(rank) >= plan["a"]) & (F.col(rank) < plan["b"]))
    return joined.select(*keep, "size", "text_crc32", F.lit("rows").alias("law"), plan["h"].alias("shard"), (plan["p"] + F.col(rank) - plan["a"]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), plan["r"].alias("ring_shard"))
