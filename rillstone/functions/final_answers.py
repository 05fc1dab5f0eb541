"""Final answers in solutions: where they stand, how they are normalised, and which check grades them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import distributions as D
from . import math_answers as A

#: Replacements in order, and expressions that are removed in order.
SUBSTITUTIONS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
#: Phrases before and after an answer, and words that introduce its last part.
BEFORE, AFTER = ("answer:", "answer is", "answers are"), ("is answer", "is the answer", "are answers", "are the answers")
LEADS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def boxed(text: Column) -> Column:
    r"""The body of the last \boxed{}, its braces counted; NULL if there is none or it isn't closed."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        depth, at = acc["depth"] + F.when(F.endswith(piece, F.lit("{")), 1).when(F.endswith(piece, F.lit("}")), -1).otherwise(0), acc["at"] + F.length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.coalesce(acc["end"], F.when(depth == 0, at - 1)).alias("end"))

    def body(tail: Column) -> Column:
        end = F.aggregate(F.split(tail, r"(?<=[{}])"), start, step, lambda acc: acc["end"])  # a piece ends with its brace
        return D.let(end, lambda e: F.when(e.isNotNull(), F.substring(tail, F.lit(1), e)))

    return D.let(text, lambda t: D.let(F.when(F.contains(t, F.lit("\\boxed{")), F.substring_index(t, "\\boxed{", -1)), body))


def normalised(answer: Column) -> Column:
    """A final answer in a plain form: what follows the last equals sign, units and mark-up removed, fractions and roots in braces, digits without commas."""
    t = F.substring_index(answer, "=", -1)
    for before, after in SUBSTITUTIONS:
        t = F.replace(t, F.lit(before), F.lit(after))
    for word in REMOVED:
        t = F.replace(t, F.lit(word), F.lit(""))
    t = F.regexp_replace(t, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for mark in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, rf"(\\{mark}\{{)(.*?)(\}})", "$2")
    t = F.regexp_replace(t, r"(\\boxed\{)(.*)(\})", "$2")
    t = F.regexp_replace(t, r"(frac)([^{])(.)", r"frac{$2}{$3}")
    t = F.regexp_replace(t, r"(sqrt)([^{])", r"sqrt{$2}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    plain = F.replace(t, F.lit(","), F.lit(""))
    return F.trim(F.when(plain.rlike(r"^\d+$"), plain).otherwise(t))


def last_answer_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1)), F.lit("[INVALID]"))


def answer_line_right(text: Column, gold: Column, gold_is_boxed: bool = False) -> Column:
    """Whether the last answer line equals the gold answer, both normalised."""
    return F.coalesce(normalised(last_answer_line(text)) == normalised(boxed(gold) if gold_is_boxed else gold), F.lit(False))


def strict_box(text: Column, gold: Column, last: int = 100) -> Column:
    """1 if the last box within the last characters equals the gold answer, else -1."""
    tail = D.let(text, lambda t: F.when(F.length(t) > last, F.substring(t, F.length(t) - last + 1, F.lit(last))).otherwise(t))
    return F.when(F.coalesce(boxed(tail) == gold, F.lit(False)), 1).otherwise(-1)


def verified(text: Column, gold: Column, strict: bool = False) -> Column:
    return strict_box(text, gold) == 1 if strict else answer_line_right(text, gold)


def _boxed_text(text: str) -> str | None:
    start = text.rfind("\\boxed{")
    depth = 0
    for k in range(start + 6, len(text)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if depth == 0:
            return text[start + 7 : k]
    return None


def _lowered(text: str) -> str:
    """Lower case, place by place: the few letters that grow when lowered stay, so that positions hold in the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _cut(text: str) -> tuple[bool, str]:
    marked = False
    rules = [(m, True) for m in BEFORE] + [(m, False) for m in AFTER] + [(None, None), (". ", False)] + [(m, True) for m in LEADS]
    for mark, keep_tail in rules:
        if mark is None:
            inner = _boxed_text(text)
            marked, text = marked or inner is not None, text if inner is None else inner
            continue
        head, found, _ = _lowered(text).rpartition(mark)
        if found:
            at = len(head)
            text = (text[at + len(mark) :] if keep_tail else text[:at]).strip()
            marked = marked or mark != ". "
    return marked and any(c.isdigit() for c in text), text


@F.pandas_udf(T.StructType([T.StructField("matched", T.BooleanType()), T.StructField("answer", T.StringType())]))
def cut_answer(text: pd.Series) -> pd.DataFrame:
    """(matched, answer): last occurrences of marker phrases cut the text, a box is preferred, an answer needs a digit.

    In Arrow batches: each cut depends on the one before, and as nested expressions they would grow exponentially.
    """
    return pd.DataFrame([(None, None) if t is None else _cut(t) for t in text], columns=["matched", "answer"])


def thought_and_box_format(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), F.lit(False))


def weighted(text: Column, gold: Column, use_box: bool = True, format_share: float = 0.1) -> Column:
    """Accuracy and format, weighted."""
    right = A.equal(boxed(text) if use_box else text, gold).cast("double")
    return (1 - format_share) * right + format_share * thought_and_box_format(text).cast("double")


def after_thought_right(text: Column, golds: Column, opening: str = "<think>", closing: str = "</think>") -> Column:
    """Whether the box after the closing tag equals any gold answer; golds may be boxed themselves. Without both tags, or a box, it is wrong."""
    tail = D.let(text, lambda t: F.when(F.contains(t, F.lit(opening)) & F.contains(t, F.lit(closing)), F.get(F.split(t, closing), F.lit(1))))
    return D.let(boxed(tail), lambda answer: F.coalesce(F.exists(golds, lambda g: A.equal(answer, F.coalesce(boxed(g), g))), F.lit(False)))


def boxed_or_typed(text: Column) -> Column:
    """The box's body with the quotes of a string literal removed: metadata that was written as text gets its plain value."""
    body = boxed(text)
    return F.when(body.rlike(r"""^(["']).*\1$"""), F.substring(body, F.lit(2), F.length(body) - 2)).otherwise(body)


def any_check(*checks: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A grader that accepts what any check accepts; a check that gives NULL doesn't count."""

    def grade(text: Column, gold: Column) -> Column:
        out = F.lit(False)
        for check in checks:
            out = out | F.coalesce(check(text, gold), F.lit(False))
        return out

    return grade
