"""Token-level arithmetic on array columns: masked means, log-softmax at labels, lengths, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distributions import logsumexp, total


def masked_sum(v: Column, mask: Column) -> Column:
    return total(F.zip_with(v, mask, lambda x, m: F.when(m > 0, x.cast("double")).otherwise(0.0)))


def masked_mean(v: Column, mask: Column, eps: float = 1e-8) -> Column:
    return masked_sum(v, mask) / (total(F.transform(mask, lambda m: (m > 0).cast("double"))) + F.lit(eps))


def log_prob_at(logits: Column, label: Column) -> Column:
    """log softmax of the logits at the label (from 0)."""
    return F.get(logits, label.cast("int")) - logsumexp(logits)


def is_argmax(logits: Column, label: Column) -> Column:
    """Whether the first largest logit is the label's."""
    return F.array_position(logits, F.array_max(logits)) - 1 == label


def cross_entropy(logits: Column, labels: Column, ignored: int = -100) -> tuple[Column, Column, Column]:
    """(mean loss, token accuracy, counted tokens) of a sequence of logit rows and labels; the denominator is 1 at least."""
    terms = F.zip_with(logits, labels, lambda z, y: F.struct(F.when(y != ignored, -log_prob_at(z, y)).otherwise(0.0).alias("l"), F.when(y != ignored, is_argmax(z, y).cast("double")).otherwise(0.0).alias("a"), F.when(y != ignored, 1.0).otherwise(0.0).alias("n")))
    sums = F.aggregate(terms, F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("n")), lambda s, x: F.struct((s["l"] + x["l"]).alias("l"), (s["a"] + x["a"]).alias("a"), (s["n"] + x["n"]).alias("n")))
    n = F.greatest(sums["n"], F.lit(1.0))
    return sums["l"] / n, sums["a"] / n, sums["n"]


def cumulative(lengths: Column) -> Column:
    """0 and the running sums of a list of lengths."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def inverse_permutation(p: Column) -> Column:
    at = F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(at), lambda s: s["i"])


def decoded(ids: Column, words: Column, pad: int, eos: int) -> Column:
    """Words of the ids up to the first end id, pads dropped, joined by blanks."""
    end = F.array_position(ids, eos)
    cut = F.when(end > 0, F.slice(ids, F.lit(1), end.cast("int") - 1)).otherwise(ids)
    return F.array_join(F.transform(F.filter(cut, lambda x: x != pad), lambda i: F.coalesce(F.get(words, i.cast("int")), F.lit("?"))), " ")


def token_of_char(ends: Column, offset: Column) -> Column:
    """The index of the token that holds a character, from the tokens' end offsets; clamped to the last."""
    before = F.size(F.filter(ends, lambda e: e <= offset))
    return F.least(before, F.size(ends) - 1)


def reshaped(v: Column, width: int) -> Column:
    """A list as rows of ``width``."""
    n = F.ceil(F.size(v) / F.lit(width)).cast("int")
    return F.when(F.size(v) == 0, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(v, k * width + 1, F.lit(width))))


def differences(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.when(i > 0, x - F.get(v, i - 1)).otherwise(x))
