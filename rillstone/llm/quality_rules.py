"""Quality rules with risk-controlled thresholds.

Each rule compares one feature of a text with a cutoff. Cutoffs are chosen per stratum (language), so that all rules together reject less than ALPHA of
the stratum's good documents, with a confidence of 1 - DELTA over all strata:

* A third of the labelled documents, by hash, orders the steps. A step makes one rule stricter; steps come in the order of the good documents that the rule rejects there, so each step's rules
  reject all that the steps before reject.
* The other labelled documents test the steps in that order. A step passes if an exact binomial (Clopper-Pearson) bound on the share of good documents that the
  rules reject together is below ALPHA at confidence 1 - DELTA / strata (Bonferroni); the first step that fails ends the tests
  (fixed-sequence testing, so that no further correction is needed).
* The last step that passes gives the cutoffs. With too few labels none passes and the rules stay off.

Defined results: null and empty texts have no words and fail the base rule; very long texts are counted whole; a null
lang is a stratum of its own; documents of a stratum without labels are judged by the base rule
alone; labels that repeat or are null: a document with any label 0 is bad, null labels are ignored; ties in the order of steps go by the rules' order, gentler cutoffs first; an
empty table gives no rows. Rows that repeat are judged each. Extra columns ride along in ``keep_good``, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, lean, with_membership, written

#: False rejection allowed per stratum, by all rules together, and the chance that any stratum's bound fails.
ALPHA, DELTA = 0.01, 0.05
#: One labelled document in so many orders the steps, the others test them.
ORDERING = 3
#: Rules: a feature, and the cutoffs tried; a text is rejected if its feature is above.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": tuple(k / 100 for k in range(2, 32, 2)),
    "upper_share": tuple(k / 20 for k in range(4, 20)),
    "shout_share": tuple(k / 20 for k in range(1, 20)),
    "pipe_share": tuple(k / 50 for k in range(1, 26)),
    "dup_line_share": tuple(k / 20 for k in range(2, 20)),
    "repeat_share": tuple(k / 50 for k in range(2, 20)),
    "same_word_share": tuple(k / 20 for k in range(1, 20)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT = 10, 20


def text_features(text: str | None) -> tuple:
    """The base counts of a text, then the rules' features in order."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = sum(text.count(c) for c in SYMBOLS[1:-1])
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(grams)) < len(grams):
            count, end = Counter(grams), 0
            for k, g in enumerate(grams):
                if count[g] > 1:
                    repeated += k + 5 - max(end, k)
                    end = k + 5
    upper = sum(map(bytes.isupper, words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    rate = lambda x, of: x / of if of else 0.0
    return (
        n, chars, symbols, dup, repeated,
        rate(symbols, chars), rate(upper, n), rate(text.count("!!"), n), rate(text.count("|"), n), rate(dup, lines), rate(repeated, n), rate(same, n),
    )


def _features(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Columns of the batch, then the features of the text in column ``at``."""
    kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(RULES)
    for batch in lean(batches):
        rows = [text_features(x.as_py()) for x in batch.column(at)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        extra = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *[f"f{k}" for k in range(len(kinds))]])


def with_features(docs: DataFrame, keep_text: bool) -> tuple[DataFrame, dict[str, str]]:
    """docs with the feature columns (and without the text), and the features' column names."""
    names = [*BASE, *RULES]
    own = free_names(docs, *names)
    kinds = [T.LongType()] * len(BASE) + [T.DoubleType()] * len(RULES)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(own[n], k) for n, k in zip(names, kinds, strict=True)]])
    at = [c.lower() for c in docs.columns].index("text")
    out = docs.mapInArrow(functools.partial(_renamed, at=at, names=schema.names), schema)
    return (out if keep_text else out.drop("text")), own


def _renamed(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in _features(batches, at):
        yield batch.rename_columns(names)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exact, through the incomplete beta function."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound on a rate of which k cases were seen in n."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


STEPS = "no_stratum boolean, stratum string, rule string, cutoff double, step int"


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The steps of one stratum in order: cutoffs that reject bad documents, and more of them than the rule's gentler cutoffs."""
    names, steps = list(RULES), []
    for r in pdf.sort_values(["rule", "cutoff"], ascending=[True, False]).itertuples():
        steps.append((int(r.good_hit), names.index(r.rule), -float(r.cutoff), int(r.bad_hit)))
    chosen, most = [], dict.fromkeys(range(len(names)), 0)
    for good, rule, cutoff, bad in sorted(steps):
        if bad > most[rule]:
            most[rule] = bad
            chosen.append((names[rule], -cutoff))
    one = pdf.iloc[0]
    rows = [(bool(one.no_stratum), one.stratum, rule, cutoff, k) for k, (rule, cutoff) in enumerate(chosen)]
    return pd.DataFrame(rows, columns=["no_stratum", "stratum", "rule", "cutoff", "step"])


def last_safe_step(hits: dict[int, int], good: int, steps: int, alpha: float, delta: float) -> int:
    """The last step that passes, or -1; hits: good documents by the first step that rejects them."""
    rejected = 0
    for step in range(steps):
        rejected += hits.get(step, 0)
        # the bound is at most alpha just if so few rejections would be that unlikely at a rate of alpha
        if binomial_cdf(rejected, good, alpha) > delta:
            return step - 1
    return steps - 1


def _test(pdf: pd.DataFrame, alpha: float, delta: float) -> pd.DataFrame:
    """The cutoffs of one stratum; rows: good documents by first rejecting step (-1: by none), and the steps themselves."""
    one, steps = pdf.iloc[0], pdf[pdf["rule"].notna()]
    found = pdf[pdf["rule"].isna()]
    hits = dict(zip(found["step"].astype(int), found["n"].astype(int), strict=True))
    last = last_safe_step(hits, sum(hits.values()), len(steps), alpha, delta / max(1, int(pdf["strata"].max())))
    passed = steps[steps["step"] <= last].groupby("rule")["cutoff"].min()
    rows = [(bool(one.no_stratum), one.stratum, rule, float(cutoff)) for rule, cutoff in passed.items()]
    return pd.DataFrame(rows, columns=["no_stratum", "stratum", "rule", "cutoff"])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, is_good) of the documents with a label."""
    return labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("is_good"))


def fit_cutoffs(features: DataFrame, names: dict[str, str], alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: no_stratum, stratum and a cutoff per rule (null: off).

    features: doc_id, lang, is_good and the feature columns of the labelled documents. All counting is by groups; a stratum leaves as many rows as there are
    cutoffs. Rows that repeat a doc_id count once, by the smallest of their features.
    """
    stratum = ["no_stratum", "stratum"]
    used = ["lang", "is_good", *[names[r] for r in RULES]]
    features = features.groupBy("doc_id").agg(F.min(F.struct(*used)).alias("_least")).select("doc_id", "_least.*")
    rows = features.select("doc_id", F.col("lang").isNull().alias("no_stratum"), F.coalesce("lang", F.lit("")).alias("stratum"), "is_good", *[F.col(names[r]).alias(r) for r in RULES])
    rows = written(rows.withColumn("orders", F.pmod(F.xxhash64("doc_id"), F.lit(ORDERING)) == 0), "quality-labelled")
    every = [(r, k, float(c)) for r, cuts in RULES.items() for k, c in enumerate(cuts)]
    counts = rows.filter("orders").groupBy(*stratum, "is_good").agg(*[F.expr(f"count_if({r} > {c!r}D) AS {r}_{k}") for r, k, c in every])
    cells = ", ".join(f"struct('{r}' AS rule, {c!r}D AS cutoff, {r}_{k} AS hit)" for r, k, c in every)
    long = counts.select(*stratum, "is_good", F.explode(F.expr(f"array({cells})")).alias("x"))
    side = lambda good: F.coalesce(F.max(F.when(F.col("is_good") == good, F.col("hit"))), F.lit(0))
    table = long.select("*", "x.*").groupBy(*stratum, "rule", "cutoff").agg(side(True).alias("good_hit"), side(False).alias("bad_hit"))
    steps = written(table.groupBy(*stratum).applyInPandas(_order, STEPS), "quality-steps")

    # each good document of the others by the first step that rejects it
    wide = steps.groupBy(*stratum).agg(*[F.collect_list(F.when(F.col("rule") == r, F.struct("step", "cutoff"))).alias(f"steps_{r}") for r in RULES])
    tested = rows.filter("not orders and is_good").join(wide, stratum)
    beyond = 1 << 30
    first = F.least(*[F.coalesce(F.array_min(F.transform(F.filter(f"steps_{r}", _under(r)), lambda x: x["step"])), F.lit(beyond)) for r in RULES])
    seen = tested.groupBy(*stratum, first.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.select(*stratum, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("double").alias("cutoff"), F.when(F.col("first") == beyond, -1).otherwise(F.col("first")).cast("int").alias("step"), "n")
    both = written(seen.unionByName(steps.withColumn("n", F.lit(0).cast("long"))), "quality-tests")
    strata = rows.select(*stratum).distinct().count()
    chosen = both.withColumn("strata", F.lit(strata)).groupBy(*stratum).applyInPandas(lambda pdf: _test(pdf, alpha, delta), "no_stratum boolean, stratum string, rule string, cutoff double")
    wide = chosen.groupBy(*stratum).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    return written(wide, "quality-cutoffs")


def _under(rule: str) -> Callable[[Column], Column]:
    return lambda x: F.col(rule) > x["cutoff"]


def judge(rows: DataFrame, cutoffs: DataFrame, names: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """rows with base_failed and kept. The cutoffs are one row a stratum; Spark broadcasts them if their size allows."""
    own = free_names(rows, "base_failed", "kept", "no_stratum", "stratum", *[f"cut_{r}" for r in RULES])
    cutoffs = cutoffs.select(*[F.col(c).alias(own[c]) for c in cutoffs.columns])
    n = F.col(names["n_words"])
    rows = rows.withColumn(own["base_failed"], (n < MIN_WORDS) | (100 * F.col(names["n_repeat_words"]) > MAX_REPEAT * n))
    rows = rows.join(cutoffs, (F.col("lang").isNull() == F.col(own["no_stratum"])) & (F.coalesce("lang", F.lit("")) == F.col(own["stratum"])), "left")
    over = functools.reduce(lambda a, b: a | b, [F.coalesce(F.col(names[r]) > F.col(own[f"cut_{r}"]), F.lit(False)) for r in RULES])
    return rows.withColumn(own["kept"], ~F.col(own["base_failed"]) & ~over), own


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, names = with_features(docs.select("doc_id", "lang", "text"), keep_text=False)
    rows = written(rows, "quality-features")
    rows, own = judge(rows, fit_cutoffs(rows.join(labelled(labels), "doc_id"), names), names)
    return rows.select("doc_id", *BASE, F.col(own["base_failed"]), F.col(own["kept"]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns. Cutoffs come from features of the labelled documents alone; the membership filter finds them in the scan, so no text is shuffled."""
    known = labelled(labels)
    rows = with_membership(docs.select("doc_id", "lang", "text"), F.xxhash64("doc_id"), known.select(F.xxhash64("doc_id").alias("h")), "maybe").filter("maybe").drop("maybe")
    narrow, names = with_features(rows, keep_text=False)
    cutoffs = fit_cutoffs(narrow.join(known, "doc_id"), names)
    rows, names = with_features(docs, keep_text=True)
    rows, own = judge(rows, cutoffs, names)
    return rows.filter(F.col(own["kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])
