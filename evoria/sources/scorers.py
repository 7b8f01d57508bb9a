"""Scorers as columns: cached model outputs first, then a pluggable batch function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BatchScorer = Callable[["object", "object"], "object"]


def cache_key(df: DataFrame, a: str, b: str, model: str) -> DataFrame:
    return df.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", F.lit(model), a, b).cast("binary"), 256))


def score(pairs: DataFrame, a: str, b: str, model: str, cache: DataFrame, judge: BatchScorer) -> DataFrame:
    """``pairs`` with ``p``: from ``cache(cache_key, p)``, or of ``judge(list_a, list_b)`` for the pairs that it lacks.

    The function gets Arrow batches as pandas series, so a model is called once for each batch.
    """
    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    @pandas_udf("double", PandasUDFType.SCALAR)
    def run(x, y):
        return pd.Series(judge(x, y))

    keyed = cache_key(pairs, a, b, model)
    known = keyed.join(cache.select("cache_key", "p"), "cache_key")
    missing = keyed.join(cache, "cache_key", "left_anti").withColumn("p", run(a, b))
    return known.unionByName(missing).drop("cache_key")


def jaccard_judge(x, y):
    """A scorer without a model: overlap of lower-cased words."""
    import pandas as pd

    def one(s, t):
        p, q = set((s or "").lower().split()), set((t or "").lower().split())
        return len(p & q) / len(p | q) if p | q else 0.0

    return pd.Series([one(s, t) for s, t in zip(x, y)])
