"""Every registered query of the engine against its oracle in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from evoria import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.8g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    assert Counter(repr([plain(r[c]) for c in names]) for r in rows) == Counter(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_names_and_entry(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.entry(spark, SF).count() > 0


def test_entry_module_survives_without_the_corpus_parts(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("evoria.llm", "corpus_pipeline") else real(name, *a))
    assert set(__spark_entry__.queries()) == set(catalog.queries())
    assert os.path.exists(__spark_entry__.__file__)
