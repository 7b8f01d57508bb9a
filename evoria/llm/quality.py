"""Quality rules whose thresholds come from mergeable quantile sketches per language and source (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, free_name, materialize, text_or_empty

#: Least number of words, and the largest share (percent) of words in repeated windows, of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: metric -> (numerator, denominator, scale); no metric has a cutoff of its own.
METRICS = {
    "word_length": ("word_chars", "n_words", 100),
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
}
#: Quantiles that fences are made of, and how many spreads a fence is away from the upper one.
QUANTILES = {"q25": (1, 4), "q50": (1, 2), "q75": (3, 4), "q90": (9, 10)}
SPREADS = 6
#: A document goes where its count is more than so many standard errors (of a count) above what the fence allows.
ERRORS = 3
#: Groups with fewer documents use the sketch of their language, then that of all documents.
MIN_GROUP = 50
#: Largest number of (language, source) groups whose thresholds are broadcast.
BROADCAST_GROUPS = 20_000


def base_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words word_chars n_symbols n_dup_lines n_lines n_repeat_words base_failed``.

    A null or empty text has no word and fails the base rule. Windows of three words are sorted by a 64-bit hash and
    their places, and neighbours of one hash are compared word by word; nothing leaves the row. (A window would be missed
    if another one of its text had the same hash and stood between it and its only equal.)
    """
    w, s, p, lines = (free_name(df, n) for n in ("_words", "_sorted", "_places", "_lines"))
    body = text_or_empty(text)
    # each array is used at least twice in the step after, so the optimizer does not inline it into a lambda
    df = df.withColumns({
        w: F.filter(F.split(body, SPACE), lambda x: x != ""),
        lines: F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
    })
    window = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("h"), i.alias("i")))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        s: F.sort_array(window),
    }).drop(lines)
    word = lambda x, k: F.get(F.col(w), x["i"] + k)
    same = lambda x, y: (x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    twice = F.filter(s, lambda x, j: same(x, F.get(F.col(s), j - 1)) | same(x, F.get(F.col(s), j + 1)))
    df = df.withColumn(p, F.when(F.size(s) > 1, F.sort_array(F.transform(twice, lambda x: x["i"]))).otherwise(F.array().cast("array<int>"))).drop(s, w)
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col(p), k + 1), x + 3) - x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", covered).drop(p)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def metric(name: str) -> Column:
    top, bottom, scale = METRICS[name]
    return F.expr(f"({top} * {scale}L) div greatest({bottom}, 1L)")


def sketch_key(value: Column) -> Column:
    """Lower end of the sketch's bin: exact below 64, then 64 bins for each power of two (relative error 1/64)."""
    shift = F.length(F.bin(value)) - 7
    return F.when(value < 64, value).otherwise(value - F.pmod(value, F.pow(F.lit(2.0), shift.cast("double")).cast("long")))


def _fences(bins: DataFrame, keys: list[str]) -> DataFrame:
    """``total, body, tail`` of every (keys, metric) from merged bins.

    ``body`` is above the quarters of the group: a quarter of bad documents does not move it. ``tail`` is above the top
    tenth, for metrics that are zero in most documents.
    """
    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys, "metric")
    run = merged.withColumns({"total": F.sum("n").over(over), "upto": F.sum("n").over(over.orderBy("bin"))})
    at = (F.min(F.when(den * F.col("upto") >= num * F.col("total"), F.col("bin"))).alias(q) for q, (num, den) in QUANTILES.items())
    found = run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *at)
    above = lambda high, low: F.col(high) + SPREADS * (F.col(high) - F.col(low))
    return found.select(*keys, "metric", "total", above("q75", "q25").alias("body"), above("q90", "q50").alias("tail"))


def thresholds(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each (lang, source): ``g_lang, g_source`` and a fence ``t_<metric>`` for every metric.

    The sketch is a count for each bin, so sketches of parts add up in any order, and reruns agree. Documents that
    fail the base rule take no part. Null is a language and a source of its own. A fence is the group's ``body``, or
    the least ``tail`` of the group, its language and all documents where that is higher: what is usual in a group is
    allowed there, and a group's few bad documents do not raise its fence above what is usual elsewhere.
    """
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), sketch_key(metric(m)).alias("bin")) for m in METRICS))
    groups = features.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), "base_failed", pairs.alias("pairs"))
    bins = groups.filter(~F.col("base_failed")).select("g_lang", "g_source", F.explode("pairs").alias("x")).groupBy("g_lang", "g_source", "x.metric", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    bins = materialize(bins, "quality-sketches")
    own = _fences(bins, ["g_lang", "g_source"])
    of_lang = _fences(bins, ["g_lang"]).select(F.col("g_lang").alias("l"), F.col("metric").alias("lm"), F.col("total").alias("l_total"), F.col("body").alias("l_body"), F.col("tail").alias("l_tail"))
    of_all = _fences(bins, []).select(F.col("metric").alias("am"), F.col("body").alias("a_body"), F.col("tail").alias("a_tail"))
    # one row per metric and language, or per metric: four rows here for all documents
    both = own.join(of_lang, own["g_lang"].eqNullSafe(of_lang["l"]) & (own["metric"] == of_lang["lm"])).join(F.broadcast(of_all), F.col("metric") == F.col("am"))
    body = F.when(F.col("total") >= MIN_GROUP, F.col("body")).when(F.col("l_total") >= MIN_GROUP, F.col("l_body")).otherwise(F.col("a_body"))
    tail = F.least(F.when(F.col("total") >= MIN_GROUP, F.col("tail")), F.when(F.col("l_total") >= MIN_GROUP, F.col("l_tail")), F.col("a_tail"))
    return both.groupBy("g_lang", "g_source").agg(*(F.max(F.when(F.col("metric") == m, F.greatest(body, tail))).alias(f"t_{m}") for m in METRICS))


def within_fence(name: str) -> Column:
    """Whether the metric's count is at most ``ERRORS`` standard errors (its root) above what the fence allows.

    A short document's share is known only roughly: two repeated lines of three are no sign by themselves.
    """
    top, bottom, scale = (F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in METRICS[name])
    count, allowed = top.cast("double") * scale, F.col(f"t_{name}").cast("double") * bottom
    return (count <= allowed) | ((count - allowed) * (count - allowed) <= ERRORS * ERRORS * count * scale)


def judge(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``kept``: false where the base rule fails or any metric is above the fence of the row's group."""
    fences = materialize(thresholds(features, lang, source), "quality-fences")
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    within = F.lit(True)
    for m in METRICS:
        within = within & within_fence(m)
    joined = features.join(fences, features[lang].eqNullSafe(fences["g_lang"]) & features[source].eqNullSafe(fences["g_source"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop("g_lang", "g_source", *(f"t_{m}" for m in METRICS))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed")


def quality_rules(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for every row.

    Whole texts are read once; only the counts are stored between the two passes. Null key, language or source is
    allowed; an empty table gives an empty result; equal rows get equal results.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    stored = materialize(base_features(slim, "_text").drop("_text"), "quality-features")
    return judge(stored, "_lang", "_source").select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns of ``df``."""
    columns = df.columns
    packed = df.select(F.struct(*columns).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    stored = materialize(base_features(packed, "_text").drop("_text"), "quality-documents")
    return judge(stored, "_lang", "_source").filter("kept").select("_row.*")
