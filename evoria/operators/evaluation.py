"""Evaluation of judges and classifiers, and building of training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import seeded_order


def _by_score(df: DataFrame, label: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives of each distinct score, with running counts: the windows hold scores, not rows."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label), 0).otherwise(1)).alias("q"))
    upto = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    return counts.withColumns({"p_below": F.coalesce(F.sum("p").over(upto), F.lit(0)), "q_below": F.coalesce(F.sum("q").over(upto), F.lit(0)), "all_p": F.sum("p").over(whole), "all_q": F.sum("q").over(whole)})


def auroc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties at their mean rank; null where a class is missing."""
    t = _by_score(df, label, score, groups)
    u = F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2))
    out = t.groupBy(*groups).agg(u.alias("u"), F.max("all_p").alias("n_pos"), F.max("all_q").alias("n_neg"))
    return out.select(*groups, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def best_threshold(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """The lowest score with the best accuracy of ``score >= threshold``."""
    t = _by_score(df, label, score, groups).withColumn("right", F.col("all_p") - F.col("p_below") + F.col("q_below"))
    best = t.groupBy(*groups).agg(F.max(F.struct("right", (-F.col(score)).alias("back"))).alias("x"), F.max(F.col("all_p") + F.col("all_q")).alias("n"))
    return best.select(*groups, (F.col("x.right") / F.col("n")).alias("accuracy"), (-F.col("x.back")).alias("threshold"))


def reliability(df: DataFrame, label: str, score: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """(bin, n, mean score, share of positives); the last bin holds 1.0."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(score).isNotNull()).groupBy(*groups, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.when(F.col(label), 1.0).otherwise(0.0)).alias("positives"))


def ece(df: DataFrame, label: str, score: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    r = reliability(df, label, score, bins, groups)
    return r.groupBy(*groups).agg((F.sum(F.col("n") * F.abs(F.col("positives") - F.col("mean_score"))) / F.sum("n")).alias("ece"))


def band_stats(df: DataFrame, label: str, score: str, auto: float, reject: float) -> DataFrame:
    """Shares of wrong merges, misses, automatic decisions and escalations under two thresholds."""
    p, y = F.col(score), F.col(label)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.agg(share((p >= auto) & ~y).alias("false_merge"), share((p <= reject) & y).alias("miss"), share(p <= reject).alias("auto_reject"), share((p >= auto) | (p <= reject)).alias("coverage"), share((p < auto) & (p > reject)).alias("escalation"))


def fit_temperature(df: DataFrame, label: str, logit: str, low: float = 0.05, high: float = 10.0, steps: int = 40) -> float:
    """Temperature with the least log loss, by golden section; logits are counted in steps of 0.01 first, so each probe reads few rows."""
    binned = df.select(F.round(logit, 2).alias("z"), F.col(label).alias("y")).groupBy("z", "y").agg(F.count(F.lit(1)).alias("n")).cache()
    ratio = (5**0.5 - 1) / 2

    def loss(t: float) -> float:
        signed = F.when(F.col("y"), F.col("z")).otherwise(-F.col("z")) / t
        value = F.when(signed > 0, F.log1p(F.exp(-signed))).otherwise(-signed + F.log1p(F.exp(signed)))
        return binned.agg(F.sum(F.col("n") * value)).first()[0] or 0.0

    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = loss(d)
        if b - a < 1e-4:
            break
    binned.unpersist()
    return (a + b) / 2


def spearman(df: DataFrame, a: str, b: str, tiebreak: str) -> DataFrame:
    """Correlation of ordinal ranks (ties in the order of ``tiebreak``)."""
    return ordinal_rank(ordinal_rank(df, a, tiebreak, "ra"), b, tiebreak, "rb").agg(F.corr("ra", "rb").alias("rho"))


def ordinal_rank(df: DataFrame, value: str, tiebreak: str, out: str, parts: int = 256) -> DataFrame:
    """Adds ``out``: the row's place in the order of value and tiebreak.

    Rows are cut into parts at quantiles of the value; places inside a part are added to the counts of the parts before,
    so no task sorts the whole table. At most ``parts`` quantiles and counts reach the driver or one task.
    """
    cuts = sorted(set(df.stat.approxQuantile(value, [i / parts for i in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(value) > c)) if cuts else F.lit(0)
    dealt = df.withColumn("_part", part)
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(value, tiebreak)))
    return ranked.join(before, "_part").withColumn(out, F.col("_before") + F.col("_r")).drop("_part", "_n", "_before", "_r")


def prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))


def hierarchical(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Leaf and level accuracy and the mean F1 of prefix sets of class paths."""
    g, p = F.col(gold), F.col(predicted)
    common = F.size(F.array_intersect(prefixes(g), prefixes(p)))
    f1 = F.when(common == 0, 0.0).otherwise(2 * common / (F.size(g) + F.size(p)))
    level = lambda i: F.avg(F.when(F.get(g, F.lit(i)) == F.get(p, F.lit(i)), 1.0).otherwise(0.0))
    return df.agg(F.avg(F.when(g == p, 1.0).otherwise(0.0)).alias("leaf"), level(0).alias("l1"), level(1).alias("l2"), level(2).alias("l3"), F.avg(f1).alias("hf1"))


def macro_f1(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Mean F1 over the classes that occur in the gold labels."""
    rows = df.select(gold.alias("g"), predicted.alias("p"))
    tags = rows.select(F.explode(F.array(F.struct(F.col("g").alias("c"), (F.col("g") == F.col("p")).cast("int").alias("tp"), (F.col("g") != F.col("p")).cast("int").alias("fn"), F.lit(0).alias("fp"), F.lit(1).alias("gold")), F.struct(F.col("p").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), (F.col("g") != F.col("p")).cast("int").alias("fp"), F.lit(0).alias("gold")))).alias("x")).select("x.*")
    per = tags.groupBy("c").agg(*(F.sum(x).alias(x) for x in ("tp", "fn", "fp", "gold"))).filter("gold > 0")
    return per.agg(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fn") + F.col("fp"))).alias("macro_f1"))


def confidence_bands(df: DataFrame, right: Column, confidence: Column, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, n, precision, coverage) of the answers at or above each threshold, in one pass."""
    rows = df.select(right.alias("r"), F.explode(F.array(*(F.struct(F.lit(t).alias("t"), (confidence >= t).alias("ok")) for t in thresholds))).alias("x"))
    return rows.groupBy(F.col("x.t").alias("threshold")).agg(F.count_if("x.ok").alias("n"), F.avg(F.when(F.col("x.ok"), F.when(F.col("r"), 1.0).otherwise(0.0))).alias("precision"), F.avg(F.when(F.col("x.ok"), 1.0).otherwise(0.0)).alias("coverage"))


def pair_key(a: Column, b: Column, length: int = 80) -> Column:
    x, y = F.substring(a, 1, length), F.substring(b, 1, length)
    return F.concat(F.least(x, y), F.lit("\x1f"), F.greatest(x, y))


def dedupe_pairs(pairs: DataFrame, a: str, b: str, order: Sequence[Column | str], length: int = 80) -> DataFrame:
    """The first pair in order of each unordered pair of text prefixes."""
    keyed = pairs.withColumn("_k", F.sha2(pair_key(F.col(a), F.col(b), length).cast("binary"), 256))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_n = 1").drop("_n", "_k")


def time_split(df: DataFrame, order: Sequence[str], train: float = 0.8, dev: float = 0.1, buckets: str | None = None) -> DataFrame:
    """Adds ``split``: the first share in time is train, the next dev, the rest test.

    With ``buckets`` (a coarse time column) ranks are taken inside buckets and added to the counts before them, so no
    task sorts the whole table.
    """
    key = buckets or "_all"
    base = df if buckets else df.withColumn("_all", F.lit(0))
    counts = base.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).withColumns({"_before": F.coalesce(F.sum("_c").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_c").over(Window.partitionBy())})
    ranked = base.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(counts, key)
    place = F.col("_before") + F.col("_r") - 1
    cut = lambda x: F.floor(F.col("_total") * x)
    return ranked.withColumn("split", F.when(place < cut(train), "train").when(place < cut(round(train + dev, 6)), "dev").otherwise("test")).drop("_c", "_before", "_total", "_r", "_all")


def downsample(df: DataFrame, label: str, key: str, ratio: int, seed: str) -> DataFrame:
    """All positives and at most ``ratio`` negatives for each, the first in a seeded order.

    Counts of the order's 4,096 leading parts tell where the cut falls: whole parts before it stay, and only the part that
    holds it is sorted.
    """
    positives, rest = df.filter(F.col(label)), df.filter(~F.col(label))
    part = F.conv(F.substring(seeded_order(key, seed), 1, 3), 16, 10).cast("int")
    counts = {r["p"]: r["n"] for r in rest.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left, cut = positives.count() * ratio, 0
    while cut < 4096 and counts.get(cut, 0) <= left:
        left -= counts.get(cut, 0)
        cut += 1
    kept = positives.unionByName(rest.filter(part < cut))
    return kept.unionByName(rest.filter(part == cut).orderBy(seeded_order(key, seed), key).limit(left)) if cut < 4096 and left else kept


def stratified(df: DataFrame, stratum: str, quotas: dict[str, int], key: str, seed: str) -> DataFrame:
    """At most the quota of each stratum, in a seeded order."""
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    w = Window.partitionBy(stratum).orderBy(seeded_order(key, seed), key)
    return df.filter(F.col(stratum).isin(*quotas)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= max(quotas.values())) & (F.col("_n") <= quota[F.col(stratum)])).drop("_n")


def negatives(positives: DataFrame, pool: DataFrame, split: str, per: int, seed: str, key: str) -> DataFrame:
    """``per`` pool rows of the same split for each positive, by slots of a seeded order (with repeats)."""
    p = pool.withColumn("_slot", F.row_number().over(Window.partitionBy(split).orderBy(seeded_order(key, seed), key)) - 1)
    size = pool.groupBy(split).agg(F.count(F.lit(1)).alias("_size"))
    asked = positives.join(size, split).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    start = F.conv(F.substring(seeded_order("pos_id", seed), 1, 8), 16, 10).cast("long")
    return asked.withColumn("_slot", ((start + F.col("_j")) % F.col("_size")).cast("int")).join(p, [split, "_slot"])


def intra_pairs(members: DataFrame, group: str, member: str, offsets: Sequence[int], cap: int) -> DataFrame:
    """Pairs of group members whose ranks differ by one of ``offsets``, at most ``cap`` a group."""
    r = members.select(group, member, F.row_number().over(Window.partitionBy(group).orderBy(member)).alias("r"))
    other = r.select(group, F.col(member).alias("b"), F.col("r").alias("rb"))
    pairs = r.withColumn("rb", F.explode(F.array(*(F.col("r") + o for o in offsets)))).join(other, [group, "rb"]).select(group, F.col(member).alias("a"), "b", "r", "rb")
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("r", "rb"))).filter(F.col("n") <= cap).select(group, "a", "b")


def positional_median(df: DataFrame, value: str, key: str, first: int) -> float | None:
    """``sorted(values)[n // 2]`` of the first ``first`` rows by key (a stated bound)."""
    head = df.orderBy(key).select(value).limit(first)
    n = head.count()
    row = head.orderBy(value).offset(n // 2).limit(1).first() if n else None
    return row[0] if row else None


def overlay(base: DataFrame, fixes: DataFrame, key: str, value: str) -> DataFrame:
    """Adjudications (key, action fix or drop, new): fixed values replace, dropped rows go, the rest stays."""
    f = fixes.select(key, "action", "new")
    return base.join(f, key, "left").filter(F.coalesce(F.col("action") != "drop", F.lit(True))).withColumn(value, F.when(F.col("action") == "fix", F.col("new")).otherwise(F.col(value))).select(*base.columns)


def quota_sample(df: DataFrame, first: str, second: str, key: str, most_first: int, most_second: int, total: int, seed: str) -> DataFrame:
    """At most ``most_second`` rows of each second key, then ``most_first`` of each first key, then ``total``, in a seeded order.

    Quotas are applied one after another, which is what can be done without a sequential pass.
    """
    def limit(rows: DataFrame, by: str, n: int) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_o", key))).filter(F.col("_n") <= n).drop("_n")

    ordered = df.withColumn("_o", seeded_order(key, seed))
    return limit(limit(ordered, second, most_second), first, most_first).orderBy("_o", key).limit(total).drop("_o")
