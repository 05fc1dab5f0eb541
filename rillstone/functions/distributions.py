"""Functions of probability vectors (array columns), evaluated in the JVM by array lambdas."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def rounded(x: Column, places: int) -> Column:
    """Half away from zero, and the sign stays: what is just below zero becomes -0.0, as in IEEE and DuckDB; Spark's own round gives 0.0."""
    return F.round(F.abs(x), places) * F.signum(x)


def _each(v: Column, f) -> Column:
    return F.transform(v, f)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shares(v: Column) -> Column:
    return let(v, lambda x: let(total(x), lambda z: _each(x, lambda y: y / z)))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return let(F.array_max(logits), lambda top: _shares(_each(logits, lambda x: F.exp((x - top) / F.lit(temperature)))))


def normalised(p: Column) -> Column:
    return _shares(p)


def entropy(p: Column) -> Column:
    """-sum p ln p over p > 1e-12, after normalising."""
    return let(total(p), lambda z: -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x / z > TINY, x / z * F.ln(x / z)).otherwise(0.0)))


def kl(p: Column, q: Column) -> Column:
    """Both normalised; summed over p > 1e-12 with q clipped to [1e-12, 1]."""
    term = lambda x, y: F.when(x > TINY, x * F.ln(x / F.least(F.greatest(y, F.lit(TINY)), F.lit(1.0)))).otherwise(0.0)
    return total(F.zip_with(_shares(p), _shares(q), term))


def jsd(p: Column, q: Column) -> Column:
    def between(x: Column, y: Column) -> Column:
        middle = F.zip_with(x, y, lambda a, b: (a + b) / 2)
        return let(middle, lambda m: (kl(x, m) + kl(y, m)) / 2)

    return let(_shares(p), lambda x: let(_shares(q), lambda y: between(x, y)))


def power(p: Column, alpha: float | Column) -> Column:
    """Clipped, raised to alpha, normalised."""
    exponent = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return _shares(_each(p, lambda x: F.pow(F.least(F.greatest(x, F.lit(TINY)), F.lit(1.0)), exponent)))


def centred_log(p: Column) -> Column:
    logs = _each(p, lambda x: F.ln(F.greatest(x, F.lit(TINY))))
    return let(logs, lambda v: let(F.try_divide(total(v), F.size(v)), lambda m: _each(v, lambda x: x - m)))


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(c / (1 - c))


def logsumexp(v: Column) -> Column:
    return let(F.array_max(v), lambda top: top + F.ln(total(_each(v, lambda x: F.exp(x - top)))))


def entropy_from_logits(v: Column) -> Column:
    """logsumexp - sum p logit."""
    p = softmax(v)
    return logsumexp(v) - total(F.zip_with(p, v, lambda a, b: a * b))


def self_certainty(v: Column) -> Column:
    """logsumexp - mean."""
    return logsumexp(v) - total(v) / F.size(v)


def width_for_entropy(h: Column, actions: int, most: int) -> Column:
    """A search width in [1, most], linear in the entropy's share of ln(actions), half to even."""
    return F.bround(1 + F.least(F.greatest(h / math.log(actions), F.lit(0.0)), F.lit(1.0)) * (most - 1)).cast("int")


def top_mass(p: Column, k: int) -> Column:
    """The sum of the k largest probabilities."""
    return total(F.slice(F.reverse(F.array_sort(p)), F.lit(1), F.lit(k)))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
