"""Expressions on arrays of logits and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    scaled = F.transform(logits, lambda x: x / t)
    e = _bind(scaled, lambda z: _bind(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m))))
    return _bind(e, lambda v: _bind(total(v), lambda s: F.transform(v, lambda x: x / s)))


def mean_views(views: Column) -> Column:
    """Element-wise mean of an array of arrays of one length."""
    n = F.size(views)
    return F.transform(F.sequence(F.lit(0), F.size(views[0]) - 1), lambda i: F.aggregate(views, F.lit(0.0), lambda s, v: s + F.get(v, i)) / n)


def view_probs(logits: Column, temperature: Column | float = 1.0) -> Column:
    return mean_views(F.transform(logits, lambda v: softmax(v, temperature)))


def one_hot(gold: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == gold, 1.0).otherwise(0.0))


def argmax(p: Column) -> Column:
    """First index of the largest, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def nll(target: Column, p: Column, eps: float = 1e-12) -> Column:
    return total(F.zip_with(target, p, lambda t, x: -t * F.log(x + eps)))


def entropy(target: Column) -> Column:
    return total(F.transform(target, lambda t: F.when(t > 0, -t * F.log(t)).otherwise(0.0)))


def normalised_entropy(target: Column) -> Column:
    return entropy(target) / F.log(F.size(target).cast("double"))


def brier(target: Column, p: Column) -> Column:
    return total(F.zip_with(target, p, lambda t, x: (x - t) * (x - t)))


def tvd(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.abs(x - y))) / 2


def rps(p: Column, gold: Column) -> Column:
    """Ranked probability score: squared distance of the cumulative distributions over all levels but the last, by k - 1."""
    k = F.size(p)
    step = lambda i: F.pow(total(F.slice(p, F.lit(1), i + 1)) - F.when(i >= gold, 1.0).otherwise(0.0), 2.0)
    return F.aggregate(F.sequence(F.lit(0), k - 2), F.lit(0.0), lambda s, i: s + step(i)) / (k - 1)


def expected_correct(target: Column, p: Column) -> Column:
    return F.get(target, argmax(p))


def sharpen(p: Column, temperature: float) -> Column:
    """p^(1/T), renormalised; zeros stay."""
    w = F.transform(p, lambda x: F.when(x > 0, F.pow(x, F.lit(1.0 / temperature))).otherwise(0.0))
    return _bind(w, lambda v: _bind(total(v), lambda s: F.transform(v, lambda x: x / s)))


def rotate(a: Column, by: Column) -> Column:
    """The array begun at index `by`."""
    n = F.size(a)
    return F.when(by == 0, a).otherwise(F.concat(F.slice(a, by + 1, n - by), F.slice(a, F.lit(1), by)))


def vote_target(counts: Column, alpha: float = 0.5) -> Column:
    """Smoothed vote shares: (c + alpha / k) / (n + alpha)."""
    k = F.size(counts)
    n = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    return F.transform(counts, lambda c: (c + F.lit(alpha) / k) / (n + alpha))


def interpolated(mean: Column, levels: int) -> Column:
    """A mean level as a distribution on its two neighbours."""
    x = F.least(F.greatest(mean, F.lit(0.0)), F.lit(float(levels - 1)))
    lo = F.floor(x)
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.when(i == lo, 1.0 - (x - lo)).when(i == lo + 1, x - lo).otherwise(0.0))


def snap_policy(p: Column, *, low: float = 0.2, high: float = 0.8, margin: float = 0.0, snap: str = "argmax", eps: float = 1e-6) -> Column:
    """Commits an in-band P(yes) to the band's edge; within the margin around 0.5 it stays."""
    pivot = 0.5 if snap == "argmax" else (low + high) / 2
    moved = F.when(p >= pivot, F.least(F.lit(1.0), F.lit(high + eps))).otherwise(F.greatest(F.lit(0.0), F.lit(low - eps)))
    stays = (p <= low) | (p >= high)
    if margin > 0:
        stays = stays | (F.abs(p - 0.5) <= margin)
    return F.when(stays, p).otherwise(moved)
