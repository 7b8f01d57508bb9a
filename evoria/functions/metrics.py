"""Judge scores: squashing, routing, voting, relabelling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def softmax_first(a: Column, b: Column, temperature: float) -> Column:
    """Probability of the first of two logits."""
    return sigmoid(a - b, temperature)


def route(p: Column, auto: float = 0.9, reject: float = 0.1) -> Column:
    return F.when(p >= auto, "SAME").when(p <= reject, "DIFF").otherwise("GRAY")


def escalates(p: Column, band: float) -> Column:
    """Whether a local score is so near one half that the teacher is asked."""
    return F.abs(p - 0.5) <= band


def ensemble(logits: list[Column], weights: list[float], temperature: float) -> Column:
    """Weighted mean of logits (each the mean of both directions), squashed."""
    total = sum((w * x for w, x in zip(weights, logits)), F.lit(0.0)) / sum(weights)
    return sigmoid(total, temperature)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def and_gate(a: Column, b: Column, least_a: float, least_b: float) -> Column:
    return (a >= least_a) & (b >= least_b)


def median_of(scores: list[Column]) -> Column:
    """Median of an even or odd number of scores."""
    s, n = F.array_sort(F.array(*scores)), len(scores)
    return F.get(s, F.lit(n // 2)) if n % 2 else (F.get(s, F.lit(n // 2 - 1)) + F.get(s, F.lit(n // 2))) / 2


def median_gate(scores: list[Column], label: Column, least: float = 0.7, drop_to: float = 0.02) -> Column:
    """A positive label stays only if the median of the scorers supports it."""
    return F.when(median_of(scores) >= least, label).otherwise(F.lit(drop_to))


def votes(scores: list[Column], at: float = 0.5) -> Column:
    return sum((F.when(s >= at, 1).otherwise(0) for s in scores), F.lit(0))


def vote_kind(n_yes: Column, judges: int) -> Column:
    most = F.greatest(n_yes, judges - n_yes)
    return F.when(most == judges, "unanimous").when(most * 2 == judges, "split").otherwise("majority")


def sharpen(p: Column, flip: Column, high: float = 0.75, low: float = 0.25) -> Column:
    """Grey labels pushed outwards by an arbiter's verdict (null: left as they are)."""
    return F.when(flip.isNull(), p).when(flip, F.greatest(p, F.lit(high))).otherwise(F.least(p, F.lit(low)))


def clip(p: Column, low: float = 0.05, high: float = 0.95) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def smooth(y: Column, eps: float) -> Column:
    return y * (1 - 2 * eps) + eps
