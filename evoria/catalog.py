"""All registered queries of the engine with the SQL that checks them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from .plans.registry import ORACLES, QUERIES, Query

MODULES = ("relational", "text", "corpus", "facts", "resolution", "graphs", "evaluation", "streams", "more", "chain")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"evoria.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["Q01_fact_as_of"](spark, sf_dir)
