"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives, and a document is taken, this many times its size at most.
MOST_TIMES = 3
#: A (source, length) group with more documents is ranked in seeded parts of about this many; another number takes
#: other documents of such a group, as many as before.
PART_ROWS = 200_000
#: Largest number of sources whose targets are broadcast.
BROADCAST_SOURCES = 20_000
#: Bits of the knapsack's sums times lengths up to which its window grows beyond twice the largest length.
EXACT_BITS = 1 << 31


def size_of(text: str = "text") -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``totals(source, source_size)``: weighted shares of all words, capped.

    The level that fills all sources to ``min(level * weight, MOST_TIMES * size)`` is found in one pass over the
    sources in the order in which they reach their caps. One row for each source is sorted in one task, no document.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    placed = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", weight.cast("double"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "place")
    filled = placed.withColumn("cap", (F.col("source_size") * MOST_TIMES).cast("double")).withColumns({"all": F.sum("source_size").over(everything), "w_left": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)), "capped": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    # the level, were this source the first that stays under its cap
    level = (F.col("all") - F.col("capped")) / F.col("w_left")
    open_level = F.when(level * F.col("w") <= F.col("cap"), level)
    filled = filled.withColumn("open_level", open_level).withColumn("level", F.first("open_level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return filled.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, copies: int = 1) -> list[int]:
    """How many takes of each length bring the sum nearest to ``budget``; each document can be taken ``copies`` times.

    The budget is first spread over all lengths alike, and single documents, long ones first, fill what is left down to
    a window of the largest length. Bounded-knapsack dynamic programming (a bit for each sum) then fits the rest: it may
    add takes and take back what was spread. Sums are looked at in a window around the budget, which grows until the
    budget is met or every sum is in it; so the result is the best there is, unless ``EXACT_BITS`` stops the growth.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total * copies:
        return [c * copies for c in counts]
    take = [c * budget // total for c in counts]
    room = [c * copies for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    most = lengths[order[0]]
    # lengths that have untaken documents come before second and third takes
    for bound in (counts, room):
        for i in order:
            while left > 2 * most and (n := min(bound[i] - take[i], max(1, (left - 2 * most) // lengths[i] // len(order)), left // lengths[i])) > 0:
                take[i] += n
                left -= n * lengths[i]
    window, taken, spare = 2 * most, sum(n * t for n, t in zip(lengths, take)), sum(n * (r - t) for n, t, r in zip(lengths, take, room))
    while True:
        below, above = min(window, taken), min(left + window, spare)
        steps, at = _reach(lengths, take, [counts, room], order, left, below, above)
        done = below == taken and above == spare
        if at == left or done or (below + above) * 4 * len(order) > EXACT_BITS:
            break
        window *= 4
    at += below
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * lengths[i]
    return take


def _reach(lengths: list[int], take: list[int], bounds: list[list[int]], order: list[int], left: int, below: int, above: int) -> tuple[list[tuple[int, int, int]], int]:
    """Steps (length, takes, sums reached before), and the sum nearest to ``left`` from -``below`` to ``above``.

    A bit stands for a sum; a step is a number of takes (negative: given back) of a length, one, two, four and so on.
    """
    steps: list[tuple[int, int, int]] = []
    reach, full, mask = 1 << below, 1 << left + below, (1 << below + above + 1) - 1

    def offer(i: int, spare: int, sign: int) -> None:
        nonlocal reach
        spare, n = min(spare, (below + above) // lengths[i]), 1
        while spare > 0 and not reach & full:
            n = min(n, spare)
            grown = (reach | (reach << n * lengths[i] if sign > 0 else reach >> n * lengths[i])) & mask
            if grown != reach:
                steps.append((i, sign * n, reach))
                reach = grown
            spare -= n
            n *= 2

    done = list(take)
    for bound in bounds:
        for i in order:
            offer(i, bound[i] - done[i], 1)
            done[i] = max(done[i], bound[i])
    for i in order:
        offer(i, take[i], -1)
    low = (reach & ((full << 1) - 1)).bit_length() - 1
    high = reach >> left + below + 1
    high = left + below + (high & -high).bit_length() if high else None
    target = left + below
    at = low if high is None or low >= 0 and target - low <= high - target else high
    return steps, at - below


def quotas(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, size, n, whole, quota``: every document of the source is taken ``whole`` times; ``quota`` takes of a length come on top."""
    joined = histogram.join(targets, histogram["source"].eqNullSafe(targets["source"])).select(histogram["source"], "size", "n", "source_size", "target")

    def plan(pdf):
        pdf = pdf[pdf["size"] > 0].sort_values("size")
        if not len(pdf):
            return pdf.assign(whole=0, quota=0)[["source", "size", "n", "whole", "quota"]]
        source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(int(target // source_size), MOST_TIMES)
        budget = 0 if whole == MOST_TIMES else round(target - whole * source_size)
        take = fit(pdf["size"].tolist(), pdf["n"].tolist(), budget, MOST_TIMES - whole) if budget else 0
        return pdf.assign(whole=whole, quota=take)[["source", "size", "n", "whole", "quota"]]

    return joined.groupBy("source").applyInPandas(plan, "source string, size long, n long, whole long, quota long")


def plan_mix(sized: DataFrame, seed: int = 0) -> DataFrame:
    """``_times`` added to ``sized(_id, source, size, ...)``: how often the mix takes each row.

    Inside a length, rows are taken in the order of a seeded hash. A group that a single task should not sort is cut
    into parts of the hash's range; counts of the parts before it give a part's first rank.
    """
    histogram = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    targets = materialize(source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "mix-targets")
    plan = materialize(quotas(histogram, targets), "mix-quotas")
    small = targets.withColumnRenamed("source", "t_source")
    if targets.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART_ROWS)).cast("long")
    wanted = plan.filter("size > 0").select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), "n", "whole", "quota", parts.alias("parts"))
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    part = F.pmod(F.shiftrightunsigned(order, 20), F.col("parts"))
    rows = sized.join(wanted, sized["source"].eqNullSafe(wanted["q_source"]) & (sized["size"] == wanted["q_size"]), "left").drop("q_source", "q_size")
    rows = rows.withColumns({"_order": order, "_part": part})
    cut = materialize(rows.filter("parts > 1").groupBy("source", "size", "_part").agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    before = cut.withColumn("first", F.sum("n").over(Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("_part").alias("b_part"), "first")
    some = F.col("quota").isNotNull() & (F.col("quota") > 0)
    rank = F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_order", "_id"))
    ranked = rows.filter(some).withColumn("_rank", rank)
    ranked = ranked.join(before, ranked["source"].eqNullSafe(before["b_source"]) & (ranked["size"] == before["b_size"]) & (ranked["_part"] == before["b_part"]), "left").drop("b_source", "b_size", "b_part")
    ranked = ranked.withColumn("_times", F.col("whole") + F.floor(F.col("quota") / F.col("n")) + (F.coalesce("first", F.lit(0)) + F.col("_rank") <= F.col("quota") % F.col("n")).cast("long")).drop("first", "_rank")
    rest = rows.filter(~some).withColumn("_times", F.coalesce("whole", F.lit(0)))
    timed = ranked.unionByName(rest).drop("n", "whole", "quota", "parts", "_order", "_part")
    return timed.join(small, timed["source"].eqNullSafe(small["t_source"]), "left").drop("t_source")


def mix_report(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """``key, size, source_size, target, taken`` for every row.

    Null and empty texts have size 0 and give nothing. A null source comes last. Sources of size 0 have target 0. Equal
    rows are separate documents; which of them is taken more often does not show. An empty table gives an empty result.
    """
    sized = materialize(df.select(F.col(key).alias("_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size")), "mix-sizes")
    return plan_mix(sized, seed).select(F.col("_id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"))


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken (0 to 3 times)."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = df.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(body).alias("_text_hash"))
    slim = materialize(named.drop("_row"), "mix-sizes")
    # rows are known by id, source and text; rows that agree in all of them share their counts
    same = F.to_json(F.struct("_id", "source", "size", "_text_hash"))
    times = plan_mix(slim, seed).withColumn("_same", same).groupBy("_same").agg(F.sort_array(F.collect_list(F.col("_times").cast("int"))).alias("_all")).filter(F.array_max("_all") > 0)
    joined = named.select("_row", same.alias("_same")).join(times, "_same")
    placed = joined.withColumn("_place", F.row_number().over(Window.partitionBy("_same").orderBy("_same")))
    count = F.get(F.col("_all"), F.col("_place") - 1)
    copies = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return placed.select("_row", F.explode(copies).alias("_copy")).select("_row.*")
