"""Comparing final answers of mathematics: a canonical text, numbers, tuples and intervals. No symbolic algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distributions import let


def canonical(text: Column) -> Column:
    """Mark-up that doesn't change a value goes; simple fractions become a/b; blanks and a closing full stop go."""
    t = F.regexp_replace(text, r"\\(left|right|displaystyle|,|;|!|:| )", "")
    t = F.regexp_replace(t, r"\\(?:text|mathrm|mbox|textbf)\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    t = F.regexp_replace(t, r"\\[dt]?frac(\d)(\d)", "$1/$2")
    t = F.regexp_replace(t, r"\\sqrt(\d)", r"\\sqrt{$1}")
    t = F.regexp_replace(t, r"\^\{?\\circ\}?|\\degree|\\?%|\\?\$", "")
    t = F.regexp_replace(t, r"^[a-zA-Z]=", "")
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"\s+", ""), r"\.$", ""))


def value(text: Column) -> Column:
    """The number a canonical answer stands for: digits with commas, or a quotient of two; NULL otherwise."""
    quotient = r"^\(?(-?[\d.]+)/(-?[\d.]+)\)?$"

    def number(plain: Column) -> Column:
        top, low = F.regexp_extract(plain, quotient, 1).try_cast("double"), F.regexp_extract(plain, quotient, 2).try_cast("double")
        return F.coalesce(plain.try_cast("double"), F.try_divide(top, low))

    return let(F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?:\D|$))", ""), number)


def parts(text: Column) -> Column:
    """The members of a tuple, list or interval; a single answer is one part."""
    inner = F.when(text.rlike(r"^[(\[{].*[)\]}]$") & ~text.rlike(r"^[^,]*$"), F.regexp_extract(text, r"^.(.*).$", 1)).otherwise(text)
    return F.when(value(text).isNotNull(), F.array(text)).otherwise(F.split(inner, ","))


def brackets(text: Column) -> Column:
    """The brackets of an interval or tuple, by which open and closed ends differ."""
    return F.when(text.rlike(r"^[(\[{].*,.*[)\]}]$"), F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))).otherwise("")


def same_part(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    near = lambda u, v: F.abs(u - v) <= F.lit(tolerance) * F.greatest(F.abs(v), F.lit(1e-12))
    numbers = let(value(a), lambda x: let(value(b), lambda y: near(x, y) | near(x, y / 100) | near(x, y * 100)))
    return (a == b) | F.coalesce(numbers, F.lit(False))


def equal(answer: Column, gold: Column) -> Column:
    """Equal in every part, in order, with the same brackets; numbers within a tolerance, also as percent. Every step is evaluated once a pair."""

    def by_part(a: Column, b: Column) -> Column:
        alike = lambda p, q: (F.size(p) == F.size(q)) & F.forall(F.zip_with(p, q, lambda x, y: same_part(x, y)), lambda x: x)
        return (brackets(a) == brackets(b)) & let(parts(a), lambda p: let(parts(b), lambda q: alike(p, q)))

    pair = let(canonical(answer), lambda a: let(canonical(gold), lambda b: F.when(a == b, F.lit(True)).otherwise(by_part(a, b))))
    return F.coalesce(pair, F.lit(False))
