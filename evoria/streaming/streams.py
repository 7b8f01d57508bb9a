"""Structured Streaming forms: queues, retries, projections, slots, windows. Each runs what is available and stops."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..operators.bitemporal import step
from ..operators.graph import shared_folder
from ..operators.merge import upsert_max

MAX_ATTEMPTS = 3


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file source over one table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that ``stream`` gives for the input there is: batches go to the shared folder under their number.

    A batch that is repeated after a failure overwrites its own folder, so the sink is exactly-once. In complete mode
    the last batch is the result.
    """
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/evoria/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out/batch=*")


def enqueue(payloads: DataFrame, topic: Column, payload: Column, available_at: Column) -> DataFrame:
    """Messages with ids made of topic and payload: a message that is sent twice is one message."""
    rows = payloads.select(topic.alias("topic"), payload.alias("payload"), available_at.alias("available_at"))
    return rows.withColumns({"message_id": ids.uuid5("msg", F.col("topic"), F.col("payload")), "status": F.lit("pending"), "attempts": F.lit(0)}).dropDuplicates(["message_id"])


def claim(queue: DataFrame, now: Column, per_topic: int = 1) -> DataFrame:
    """The next available pending messages of each topic, first in first out, with one more attempt."""
    w = Window.partitionBy("topic").orderBy("available_at", "message_id")
    open_ = queue.filter((F.col("status") == "pending") & (F.col("available_at") <= now))
    return open_.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_topic).drop("_n").withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def recover(queue: DataFrame) -> DataFrame:
    """After a crash, what was running is pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def backoff_seconds(attempts: Column) -> Column:
    return F.pow(F.lit(2), F.least(attempts, F.lit(6))).cast("long")


def retries(failures: DataFrame, key: str) -> DataFrame:
    """``key, attempts, status, delay`` for each key of a stream of failures: retried with growing delays, dead after the third."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        dead = n >= MAX_ATTEMPTS
        yield pd.DataFrame({key: [k[0]], "attempts": [n], "status": ["dead" if dead else "pending"], "delay": [0 if dead else 2 ** min(n, 6)]})

    kind = failures.schema[key].dataType.simpleString()
    return failures.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, attempts long, status string, delay long", "n long", "update", GroupStateTimeout.NoTimeout)


#: Groups of slots that a stream keeps its states by; fixed for the life of its checkpoint.
SLOT_GROUPS = 4096


def slot_decisions(facts: DataFrame, slot: str, key: str) -> DataFrame:
    """``slot, key, decision`` for a stream of facts: the same step as the batch fold, state between batches.

    Slots lie in ``SLOT_GROUPS`` groups by their hash, whose states are kept and given out together: what a call into
    Python costs falls on a group, not on every slot.
    """
    import json

    from pyspark.sql.streaming.state import GroupStateTimeout

    names = ["value", "lineage", "valid_from", "valid_to", "sys_time", "correction"]

    def run(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        # slots are named by their JSON form, which tells null and numbers apart
        held: dict[str, Any] = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(batches)).sort_values(["sys_time", key])
        columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in (slot, key, *names)]
        decisions = []
        for at, _, *values in zip(*columns, strict=True):
            at = json.dumps(at)
            held[at], decision, _ = step(held.get(at), dict(zip(names, values, strict=True)))
            decisions.append(decision)
        state.update((json.dumps(held),))
        yield pd.DataFrame({slot: columns[0], key: columns[1], "decision": decisions})

    types = {c: facts.schema[c].dataType.simpleString() for c in (slot, key)}
    grouped = facts.withColumn("_group", F.pmod(F.xxhash64(slot), F.lit(SLOT_GROUPS))).groupBy("_group")
    return grouped.applyInPandasWithState(run, f"`{slot}` {types[slot]}, `{key}` {types[key]}, decision string", "state string", "update", GroupStateTimeout.NoTimeout)


def project(outbox: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The projection's watermark table after draining an outbox stream: the largest version of each aggregate.

    Every batch merges into the table of the batch before; tables are numbered, so a repeated batch gives the same one.
    """
    spark = outbox.sparkSession
    where = f"{shared_folder(spark)}/evoria/projection-{uuid.uuid4().hex}"
    schema = outbox.select(*keys, value).schema

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.createDataFrame([], schema) if number == 0 else spark.read.schema(schema).parquet(f"{where}/{number - 1}")
        upsert_max(before, batch, keys, [value]).write.mode("overwrite").parquet(f"{where}/{number}")

    q = outbox.writeStream.foreachBatch(merge).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress if p["numInputRows"]), default=0)
    return spark.read.schema(schema).parquet(f"{where}/{last}")


def counted(stream: DataFrame, at: str, late: str, window: Column, keys: list[str]) -> DataFrame:
    """Counts by event-time window and keys; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))


def watermark_key(versions: DataFrame, cluster: str, version: str) -> DataFrame:
    """One number that changes when any cluster's version does, for caches."""
    return versions.agg((F.sum(F.col(version) * 1000) + F.count(cluster)).alias("watermark"))
