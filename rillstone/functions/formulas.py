"""Equality of answer formulas by a normal form: quotients of polynomials over exact rationals and square roots.

A small helper for one pair of answers, applied to Arrow batches. Its work is bounded: LONGEST characters, TERMS terms, POWER as
an exponent. What doesn't parse, or passes the bounds, is only equal to the same text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

LONGEST, TERMS, POWER, DEPTH = 1000, 64, 32, 40
TOLERANCE = 1e-4

Poly = dict  # {(square-free number under the root, ((name, exponent), ...)): coefficient}
_TOKEN = re.compile(r"\d+\.?\d*|\.\d+|\\[a-zA-Z]+|\*\*|[a-zA-Z]+|\S")
_DROPPED = re.compile(r"(?<!\\)\\(?:left|right|displaystyle|limits|[,;!: ])|\$|\\?%|\^\{?\\circ\}?|\\degree|°")
_SAME = {"\\cdot": "*", "\\times": "*", "·": "*", "×": "*", "**": "^", "\\div": "/", "÷": "/", "−": "-", "π": "\\pi", "pi": "\\pi", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "√": "\\sqrt", "sqrt": "\\sqrt", "∞": "\\infty", "oo": "\\infty", "{": "(", "}": ")", "\\ln": "log", "\\log": "log", "ln": "log", "\\exp": "exp"}
_FUNCTIONS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "exp": math.exp}
_CONSTANTS = {"\\pi": math.pi, "\\infty": math.inf, "e": math.e}


class Unknown(Exception):
    """Beyond what is decided here."""


def _times(a: Poly, b: Poly) -> Poly:
    out: Poly = {}
    for (r, x), c in a.items():
        for (s, y), d in b.items():
            g, powers = math.gcd(r, s), dict(x)
            for name, n in y:
                powers[name] = powers.get(name, 0) + n
            sign = (-1) ** (powers.get("i", 0) % 4 // 2)
            if "i" in powers:
                powers["i"] %= 2
            key = (r * s // (g * g), tuple(sorted((n, k) for n, k in powers.items() if k)))
            out[key] = out.get(key, 0) + c * d * g * sign
    if len(out) > TERMS:
        raise Unknown
    return {k: c for k, c in out.items() if c}


def _plus(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for k, c in b.items():
        out[k] = out.get(k, 0) + sign * c
    return {k: c for k, c in out.items() if c}


class Value:
    """A quotient of polynomials, and about what number it is, if it has no variable."""

    def __init__(self, top: Poly, low: Poly | None = None, about: float | None = None):
        self.top, self.low, self.about = top, {(1, ()): Fraction(1)} if low is None else low, about
        if not self.low:
            raise Unknown

    @staticmethod
    def number(x: Fraction) -> Value:
        return Value({(1, ()): x} if x else {}, about=float(x))

    @staticmethod
    def name(name: str, about: float | None = None) -> Value:
        return Value({(1, ((name, 1),)): Fraction(1)}, about=about)

    def _about(self, other: Value, f) -> float | None:
        try:
            return None if self.about is None or other.about is None else f(self.about, other.about)
        except (ArithmeticError, ValueError):
            return None

    def plus(self, other: Value, sign: int = 1) -> Value:
        return Value(_plus(_times(self.top, other.low), _times(other.top, self.low), sign), _times(self.low, other.low), self._about(other, lambda a, b: a + sign * b))

    def times(self, other: Value) -> Value:
        return Value(_times(self.top, other.top), _times(self.low, other.low), self._about(other, lambda a, b: a * b))

    def over(self, other: Value) -> Value:
        return Value(_times(self.top, other.low), _times(self.low, other.top), self._about(other, lambda a, b: a / b))

    def rational(self) -> Fraction | None:
        if set(self.top) <= {(1, ())} and set(self.low) == {(1, ())}:
            return Fraction(self.top.get((1, ()), 0)) / self.low[1, ()]
        return None

    def key(self) -> str:
        lead = self.low[min(self.low)]
        return repr([sorted((k, c / lead) for k, c in p.items()) for p in (self.top, self.low)])

    def equals(self, other: Value) -> bool:
        return _times(self.top, other.low) == _times(other.top, self.low)

    def root(self) -> Value:
        x = self.rational()
        if x is None:
            return Value.name(f"root {self.key()}", self._about(self, lambda a, _: math.sqrt(a)))
        n, out = abs(x.numerator) * x.denominator, 1
        if n > 10**12:
            raise Unknown
        for p in range(2, math.isqrt(n) + 1):
            if p * p > n or p > 10**4:
                break
            while n % (p * p) == 0:
                n, out = n // (p * p), out * p
        if n > 10**8 and math.isqrt(n) ** 2 == n:
            n, out = 1, out * math.isqrt(n)
        powers = (("i", 1),) if x < 0 else ()
        return Value({(n, powers): Fraction(out, x.denominator)} if x else {}, about=math.sqrt(x) if x >= 0 else None)

    def power(self, other: Value) -> Value:
        n = other.rational()
        if n is not None and n.denominator == 1 and abs(n) <= POWER:
            out = Value.number(Fraction(1))
            for _ in range(abs(int(n))):
                out = out.times(self)
            return out if n >= 0 else Value.number(Fraction(1)).over(out)
        if n is not None and n.denominator == 2 and abs(n) <= POWER:
            return self.root().power(Value.number(Fraction(n.numerator)))
        return Value.name(f"power {self.key()} {other.key()}", self._about(other, lambda a, b: a**b))


class _Parser:
    """Precedence climbing; + and - bind least, then products, written or not, then powers."""

    def __init__(self, text: str):
        self.tokens = [_SAME.get(t, t) for t in _TOKEN.findall(text)]
        self.at = self.depth = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise Unknown
        self.at += 1
        return token

    def all(self) -> Value:
        out = self.sum()
        if self.peek():
            raise Unknown
        return out

    def sum(self) -> Value:
        self.depth += 1
        if self.depth > DEPTH:
            raise Unknown
        out = None
        while out is None or self.peek() in ("+", "-"):
            sign = 1
            while self.peek() in ("+", "-"):
                sign = -sign if self.take() == "-" else sign
            term = self.product()
            out = Value.number(Fraction(0)).plus(term, sign) if out is None else out.plus(term, sign)
        self.depth -= 1
        return out

    def product(self) -> Value:
        out = self.raised()
        while (token := self.peek()) and token not in ("+", "-", ")", "]", "|", ",", "="):
            if token in ("*", "/"):
                self.take()
                right = self.signed()
            else:
                right = self.raised()
            out = out.over(right) if token == "/" else out.times(right)
        return out

    def signed(self) -> Value:
        if self.peek() == "-":
            self.take()
            return Value.number(Fraction(-1)).times(self.raised())
        return self.raised()

    def raised(self) -> Value:
        base = self.atom()
        if self.peek() == "!":
            self.take()
            n = base.rational()
            if n is None or n.denominator > 1 or not 0 <= n <= 20:
                raise Unknown
            base = Value.number(Fraction(math.factorial(int(n))))
        if self.peek() != "^":
            return base
        self.take()
        return base.power(self.signed())

    def within(self, close: str) -> Value:
        out = self.sum()
        self.take(close)
        return out

    def argument(self) -> Value:
        """What a command applies to: brackets, or one token; of a number its first digit alone, as in mark-up."""
        token = self.peek()
        if token == "(":
            return self.atom()
        if token[:1].isdigit() and len(token) > 1:
            self.tokens[self.at] = token[1:]
            return Value.number(Fraction(token[0]))
        return self.atom()

    def atom(self) -> Value:
        token = self.take()
        if token == "(":
            return self.within(")")
        if token == "|":
            inside = self.within("|")
            x = inside.rational()
            return Value.number(abs(x)) if x is not None else Value.name(f"size {inside.key()}", inside.about and abs(inside.about))
        if token[0].isdigit() or token[0] == ".":
            return Value.number(Fraction(token))
        if token == "\\frac":
            top = self.argument()
            return top.over(self.argument())
        if token == "\\sqrt":
            if self.peek() != "[":
                return self.argument().root()
            self.take()
            n = self.within("]")
            return self.argument().power(Value.number(Fraction(1)).over(n))
        if token in _CONSTANTS:
            return Value.name(token, _CONSTANTS[token])
        word = token.removeprefix("\\")
        if word in _FUNCTIONS:
            inside = self.raised()
            return Value.name(f"{word} {inside.key()}", inside._about(inside, lambda a, _: _FUNCTIONS[word](a)))
        if token.startswith("\\"):
            return Value.name(token)
        if token.isalpha():
            out = Value.number(Fraction(1))
            for letter in token:  # letters side by side are a product
                out = out.times(Value.name(letter, _CONSTANTS.get(letter)))
            return out
        raise Unknown


def _clean(text: str) -> str:
    t = _DROPPED.sub("", text[:LONGEST].replace("{,}", ","))
    t = re.sub(r"\\(?:text|mathrm|mbox|textbf)\{([^{}]*)\}", r"\1", t)
    return re.sub(r"^\s*[a-zA-Z]\s*=|\.\s*$", "", t).strip()


def _digits(t: str) -> float | None:
    try:
        return float(t.replace(",", "")) if re.fullmatch(r"[-+]?[\d,]*\.?\d+(?:[eE][-+]?\d+)?|[-+]?\d[\d,]*\.?", t) else None
    except ValueError:
        return None


def _cut(t: str, at: str) -> list[str]:
    """Parts between separators outside of brackets; an interval's brackets needn't match."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(t):
        depth += (c in "([{") - (c in ")]}")
        if not depth and t.startswith(at, k):
            out.append(t[start:k])
            start = k + len(at)
    return [*out, t[start:]]


def _near(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=TOLERANCE)


_INTERVALS = {"Interval.open": "()", "Interval.Lopen": "(]", "Interval.Ropen": "[)", "Interval": "[]"}


def same(answer: str | None, gold: str | None) -> bool:
    """Equal as text, as numbers within the tolerance (also as percent), part by part with the same brackets, as matrices, as unions in any order, or as formulas."""
    if answer is None or gold is None:
        return False
    a, b = _clean(answer), _clean(gold)
    for name, (left, right) in _INTERVALS.items():
        a = re.sub(rf"^{re.escape(name)}\((.*)\)$", rf"{left}\1{right}", a)
    if a.replace(" ", "").lower() == b.replace(" ", "").lower():
        return True
    x, y = _digits(a), _digits(b)
    if x is not None and y is not None:
        return any(_near(x, v) for v in (y / 100, y, y * 100))
    if not a or not b:
        return False
    ours, theirs = (sorted(p.strip() for p in re.split(r"\\cup|∪", t)) for t in (a, b))
    if len(ours) > 1 or len(theirs) > 1:
        left = list(theirs)
        for part in ours:
            if (found := next((p for p in left if same(part, p)), None)) is None:
                return False
            left.remove(found)
        return not left
    ours, theirs = (re.fullmatch(r"\\begin\{[pbv]?matrix\}(.*)\\end\{[pbv]?matrix\}", t, re.DOTALL) for t in (a, b))
    if ours or theirs:
        cells = [[r.split("&") for r in m[1].strip().removesuffix("\\\\").split("\\\\")] if m else None for m in (ours, theirs)]
        return None not in cells and [len(r) for r in cells[0]] == [len(r) for r in cells[1]] and all(same(p, q) for r, s in zip(*cells, strict=True) for p, q in zip(r, s, strict=True))
    inside = lambda t: t[1:-1] if t[0] in "([{" and t[-1] in ")]}" else t.replace("\\{", "").replace("\\}", "")
    ours, theirs = _cut(inside(a), ","), _cut(inside(b), ",")
    if len(ours) > 1 and len(ours) == len(theirs):
        ends = [(t[0], t[-1]) if t[0] in "([" and t[-1] in ")]" else ("", "") for t in (a, b)]
        return ends[0] == ends[1] and all(same(p, q) for p, q in zip(ours, theirs, strict=True))
    try:
        u, v = _Parser(a).all(), _Parser(b).all()
        if u.equals(v):
            return True
    except (Unknown, ArithmeticError, ValueError, RecursionError):
        return False
    return u.about is not None and v.about is not None and math.isfinite(u.about) and _near(u.about, v.about)


#: Answers to one question repeat: a task remembers so many verdicts on pairs of at most so many characters.
KNOWN, SHORT = 1 << 15, 200


def _verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple, bool] = {}

    def verdict(pair: tuple) -> bool:
        if (out := known.get(pair)) is None:
            out = same(*pair)
            if len(known) < KNOWN and len(pair[0] or "") + len(pair[1] or "") <= SHORT:
                known[pair] = out
        return out

    for answer, gold in batches:
        yield pd.Series([verdict(p) for p in zip(answer, gold, strict=True)], dtype=bool)


def same_formula(answer: Column, gold: Column) -> Column:
    """``same`` of two text columns, in Arrow batches."""
    return pandas_udf(_verdicts, "boolean")(answer, gold)
