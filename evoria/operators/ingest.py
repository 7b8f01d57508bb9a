"""Documents, versions, duplicates, lineage, status, idempotent stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, text, urls
from .merge import first_writer

MIN_CONTENT = 60


def identify(items: DataFrame) -> DataFrame:
    """Adds ``source_id, origin_id, document_id, content_hash`` to items(url, title, source_name, content).

    The origin is the normalized URL, or the title's hash where there is no URL.
    """
    source = ids.uuid5("source", F.col("source_name"))
    origin = F.when(F.coalesce("url", F.lit("")) != "", urls.normalize_url(F.col("url"))).otherwise(F.sha2(F.coalesce("title", F.lit("")).cast("binary"), 256))
    out = items.withColumns({"source_id": source, "origin_id": origin, "content_hash": F.sha2(F.col("content").cast("binary"), 256)})
    return out.withColumn("document_id", ids.uuid5("doc", F.col("source_id"), F.col("origin_id")))


def split_short(items: DataFrame, content: str = "content", least: int = MIN_CONTENT) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by content length; a null content is rejected."""
    ok = F.coalesce(F.length(content) >= least, F.lit(False))
    return items.filter(ok), items.filter(~ok).withColumn("reason", F.lit("content_too_short"))


def versions(items: DataFrame, document: str, content_hash: str, order: Sequence[str]) -> DataFrame:
    """First arrival of every (document, content), numbered from 1 in each document."""
    first = first_writer(items, [document, content_hash], order)
    return first.withColumn("version_no", F.row_number().over(Window.partitionBy(document).orderBy(*order)))


def duplicates(docs: DataFrame, key: str, content: Column, order: Sequence[str]) -> DataFrame:
    """Adds ``duplicate_of``: the first document with the same content, null for that one."""
    hashed = docs.withColumn("_h", F.sha2(content.cast("binary"), 256))
    first = hashed.groupBy("_h").agg(F.min_by(F.col(key), F.struct(*order)).alias("_first"))
    return hashed.join(first, "_h").withColumn("duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_h", "_first")


def lineage(docs: DataFrame, key: str, body: str, order: Sequence[str]) -> DataFrame:
    """Adds ``lineage_group`` and ``origin_kind`` (original for the first of a group, else reprint)."""
    keyed = docs.withColumn("lineage_group", text.lineage_key(text.normalize_body(F.col(body))))
    first = keyed.groupBy("lineage_group").agg(F.min_by(F.col(key), F.struct(*order)).alias("_first"))
    return keyed.join(first, "lineage_group").withColumn("origin_kind", F.when(F.col("_first") == F.col(key), "original").otherwise("reprint")).drop("_first")


def clean_layer(items: DataFrame, key: str, company: str, content_hash: str) -> DataFrame:
    """Within a company the first item of a content stays; across companies later ones stay, marked ``duplicate_of``."""
    kept = first_writer(items, [company, content_hash], [key])
    first = items.groupBy(content_hash).agg(F.min(key).alias("_first"))
    return kept.join(first, content_hash).withColumn("duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_first")


def status(parsed: Column, extracted: Column, resolved: Column, failed: Column, duplicate: Column) -> Column:
    """State of a document version from the stages it has passed."""
    return F.when(duplicate, "duplicate_of").when(failed, "failed").when(resolved, "resolved").when(extracted, "extracted").when(parsed, "parsed").otherwise("captured")


def cache_misses(work: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose result is not cached by content hash."""
    return work.join(cache, list(keys), "left_anti")


def pending_stages(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Stage runs (stage, input_ref) that have no finished run with the same idempotency key."""
    keyed = lambda df: df.withColumn("run_key", ids.short_hash(F.concat_ws(ids.SEPARATOR, "stage", "input_ref"), 24))
    return keyed(wanted).join(keyed(done).select("run_key"), "run_key", "left_anti")


def push(spark: SparkSession, items: list[dict], order_from: int = 0) -> DataFrame:
    """Items handed in by a caller as rows with their order of arrival; missing fields are null."""
    from ..sources.files import ITEM

    names = [c.split()[0] for c in ITEM.split(", ")]
    rows = [(order_from + i, *(item.get(n) for n in names)) for i, item in enumerate(items)]
    return spark.createDataFrame(rows, "seq long, " + ITEM)


def replay(stage: Callable[[], DataFrame], path: str) -> DataFrame:
    """Run a stage again from its inputs and replace what an earlier run left at ``path``."""
    out = stage()
    out.write.mode("overwrite").parquet(path)
    return out.sparkSession.read.parquet(path)


def in_order(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """What parallel tasks gave, in the order of the input: commits are ordered, work is not."""
    return results.orderBy(*order)
