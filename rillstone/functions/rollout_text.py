"""Rows of rollouts: stored text to ids, turns, traces in parts, responses cut at their end, formats. Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lan_tokens as L
from .text import CALL, CLOSE, OPEN, SEP


def stored_ids(text: Column, vocab: dict[str, int]) -> Column:
    """Ids of words whose tokens were written together: a known word is one id; else two-character tokens before one-character ones, other characters skipped."""
    pairs, singles = [[re.escape(w) for w in vocab if len(w) == n] for n in (2, 1)]
    table = F.create_map(*[F.lit(x) for w, k in vocab.items() for x in (w, k)])
    greedy = rf"(^O-O-O|^O-O|{'|'.join([*pairs, *singles])})"

    def ids(w: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(w, F.lit(greedy), F.lit(1)), lambda t: F.try_element_at(table, t))
        return F.when(F.try_element_at(table, w).isNotNull(), F.array(F.try_element_at(table, w))).otherwise(parts)

    return F.flatten(F.transform(L.words(text), ids))


def shown(ids: Column, vocab: dict[str, int]) -> Column:
    """The tokens of ids written together, unknown ids as a question mark."""
    table = F.create_map(*[F.lit(x) for w, k in vocab.items() for x in (k, w)])
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.lit("?"))), "")


def turns(output: Column, thinking: bool = True) -> Column:
    """(thinking, own, replies): the text before the closing tag, and the segments that calls end, own ones and replies in turn; what follows the last call is left out."""
    has = output.contains(CLOSE) if thinking else F.lit(False)
    moves = F.when(has, F.trim(F.substring(output, F.locate(CLOSE, output) + len(CLOSE), F.length(output)))).otherwise(output)
    parts = F.split(moves, CALL)
    ended = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.trim(s))
    pick = lambda odd: F.filter(ended, lambda s, i: i % 2 == odd)
    return F.struct(F.when(has, F.substring_index(output, CLOSE, 1)).otherwise("").alias("thinking"), pick(0).alias("own"), pick(1).alias("replies"))


def trace_parts(text: Column) -> Column:
    """(prompt, lines, answer) of prompt, opening tag, lines between separators, opening tag, answer; with fewer tags all of it is the answer."""
    parts = F.split(text, OPEN)
    whole = F.size(parts) >= 3
    prompt = F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit(""))
    lines = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), SEP), lambda s: F.trim(s)), lambda s: s != "")
    return F.struct(F.when(whole, prompt).alias("prompt"), F.when(whole, lines).alias("lines"), F.when(whole, F.trim(F.get(parts, F.lit(2)))).otherwise(text).alias("answer"))


def response_ids(ids: Column, eos: int, pad: int) -> Column:
    """Ids without pads and without id 0, up to the first end id and with it."""
    left = F.filter(ids, lambda i: (i != pad) & (i != 0))
    end = F.array_position(left, eos)
    return F.when(end > 0, F.slice(left, F.lit(1), end.cast("int"))).otherwise(left)


def thought_and_boxed(text: Column) -> Column:
    """Whether the whole text is a thought and then a boxed answer."""
    return F.coalesce(text.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"), F.lit(False))


def warm(step: Column, warmup: int) -> Column:
    return step / F.lit(float(max(1, warmup)))


def cosine_rate(step: Column, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5) -> Column:
    """The share of the learning rate at a step: linear from ``least`` to 1, then along a cosine, never under ``least``."""
    x = F.cos(F.lit(2 * cycles) * F.pi() * (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, least + (1 - least) * warm(step, warmup)).otherwise(F.greatest(F.lit(float(least)), x * (1 - least) / 2 + (1 + least) / 2))


def constant_rate(step: Column, warmup: int) -> Column:
    return F.when(step < warmup, warm(step, warmup)).otherwise(1.0)


def stable_rate(step: Column, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5, stable: float = 0.9) -> Column:
    """Warm up, stay at 1 for the share ``stable`` of what is left, then decay along a cosine to ``least``."""
    left = max(0, total - warmup)
    held = int(left * stable)
    x = 0.5 * (1 + F.cos(F.lit(2 * cycles) * F.pi() * (step - warmup - held) / F.lit(float(max(1, left - held)))))
    decayed = F.greatest(F.lit(0.0), x) * (1 - least) + least
    return F.when(step < warmup, warm(step, warmup)).when(step < warmup + held, 1.0).when(step < total, decayed).otherwise(float(least))
