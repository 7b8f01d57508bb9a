"""Writes as pure functions: upserts, first and last writer, patches, soft deletes, constraint checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_writer(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """INSERT OR IGNORE inside one batch: the first row of each key."""
    return _nth(df, keys, [F.col(o) if isinstance(o, str) else o for o in order])


def last_writer(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """INSERT OR REPLACE inside one batch: the last row of each key."""
    return _nth(df, keys, [F.col(o).desc() for o in order])


def _nth(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``batch`` whose key it lacks, first writer first."""
    return target.unionByName(first_writer(batch, keys, order).join(target, list(keys), "left_anti"))


def insert_replace(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``target`` with every key of ``batch`` replaced by its last row."""
    return target.join(batch, list(keys), "left_anti").unionByName(last_writer(batch, keys, order))


def upsert_max(target: DataFrame, batch: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE SET v = MAX(v, new): one partial aggregation over both, no join."""
    both = target.select(*keys, *values).unionByName(batch.select(*keys, *values))
    return both.groupBy(*keys).agg(*(F.max(v).alias(v) for v in values))


def patch_coalesce(target: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """UPDATE SET c = COALESCE(patch.c, c) by key; the patch has one row for a key."""
    renamed = patch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = target.join(renamed, list(keys), "left")
    return joined.select(*((F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)) for c in target.columns))


def soft_delete(target: DataFrame, keys: DataFrame, on: Sequence[str], stamp: Column) -> DataFrame:
    """Tombstones: ``deleted_at`` set where the key is listed and the row is still live."""
    marked = target.join(keys.select(*on).distinct().withColumn("_gone", F.lit(True)), list(on), "left")
    return marked.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & F.col("_gone"), stamp).otherwise(F.col("deleted_at"))).drop("_gone")


def violations(df: DataFrame, keys: Sequence[str], live: Column | None = None) -> DataFrame:
    """Keys that break a (partial) unique constraint, with their row counts."""
    rows = df if live is None else df.filter(live)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
