"""Equality of answer formulas: the grader's cases, algebra on random formulas, bounds."""

import random

import pytest

from rillstone.functions import formulas
from rillstone.functions.formulas import same

F = pytest.importorskip("pyspark.sql.functions")

EQUAL = [
    ("(x+1)^2", "x^2+2x+1"), (r"\frac{1}{2}", "0.5"), (r"\frac12", "1/2"), (r"\dfrac{x+1}{x^2-1}", r"\frac{1}{x-1}"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"),
    (r"\sqrt{2}\sqrt{3}", r"\sqrt{6}"), ("50%", "0.5"), ("50", "50\\%"), ("1,000", "1000"), ("10{,}000", "10000"), ("$5", "5"), (r"2\pi", "6.28318"), (r"\pi r^2", r"r^2\pi"), ("x=5", "5"), (r"\left(1,2\right)", "(1, 2)"),
    ("[0,1)", "[0, 1.0)"), ("Interval.open(0, 1)", "(0,1)"), ("Interval(0, 1/2)", "[0,0.5]"), (r"(-\infty,1]\cup[3,\infty)", r"[3,\infty) \cup (-\infty, 1]"), ("1, 2, 3", "1,2,3"), (r"\begin{pmatrix}1&\frac{1}{2}\\3&4\end{pmatrix}", r"\begin{pmatrix} 1 & 0.5 \\ 3 & 2^2 \end{pmatrix}"),
    ("-(-3)", "3"), ("2^{10}", "1024"), ("x^{-1}", r"\frac{1}{x}"), ("(a-b)(a+b)", "a^2-b^2"), (r"\sqrt{-4}", "2i"), ("i^2", "-1"), ("5!", "120"), (r"\sin(x+x)", r"\sin(2x)"), (r"90^\circ", "90"), (r"\text{no solution}", "No  Solution"), ("|-3|", "3"), ("x^{1/2}", r"\sqrt{x}"), (r"3\cdot 4", "12"), (r"\log 1", "0"),
]
UNEQUAL = [
    ("(x+1)^2", "x^2+1"), (r"\frac{1}{2}", "0.51"), ("[0,1)", "(0,1)"), ("(1,2)", "(2,1)"), ("1,2", "1,2,3"), (r"\sqrt{2}", r"\sqrt{3}"), ("x", "y"), ("", "0"), ("1/0", "2/0"), (r"[0,1]\cup[2,3]", "[0,1]"), (r"\begin{pmatrix}1&2\end{pmatrix}", r"\begin{pmatrix}1\\2\end{pmatrix}"),
    ("no", "yes"), ("((", "))"), (r"\infty", r"-\infty"), (None, "1"), ("x^", "x"), (r"\sin(x)", r"\cos(x)"),
]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert same(a, b) and same(b.replace(" ", ""), a) or a.startswith("Interval")
    assert same(a, b)


@pytest.mark.parametrize(("a", "b"), UNEQUAL)
def test_unequal(a, b):
    assert not same(a, b)
    assert not same(b, a)


def test_expanded_products_are_equal():
    rng = random.Random(2)
    for _ in range(200):
        roots = [(rng.randrange(-9, 10), rng.choice("xyz")) for _ in range(rng.randrange(1, 4))]
        terms = {(): 1}
        for c, v in roots:
            new = {}
            for names, k in terms.items():
                for more, f in (((v,), 1), ((), c)):
                    key = tuple(sorted(names + more))
                    new[key] = new.get(key, 0) + k * f
            terms = new
        written = "+".join(f"({k}){''.join(n)}" for n, k in rng.sample(sorted(terms.items()), len(terms)))
        product = "".join(f"({v}+({c}))" for c, v in roots)
        assert same(product, written)
        assert not same(product, written + "+1")


@pytest.mark.parametrize("text", ["(" * 5000, "x^" * 900 + "2", "(a+b+c+d+e+f)^32", "9" * 900 + "^32", r"\sqrt" * 300 + "2", r"\frac" * 400, "1/" * 400 + "1", r"\sqrt{" + "7" * 40 + "}"])
def test_work_is_bounded(text):
    import time

    began = time.perf_counter()
    same(text, "x+1")
    assert same(text, text)
    assert time.perf_counter() - began < 2


def test_on_batches(spark):
    df = spark.createDataFrame([*EQUAL[:6], *UNEQUAL[:6], (None, None)], "a string, b string")
    got = [r["e"] for r in df.select(formulas.same_formula(F.col("a"), F.col("b")).alias("e")).collect()]
    assert sorted(got) == [False] * 7 + [True] * 6


def test_a_pair_is_decided_once_and_in_many_tasks(spark, monkeypatch, tmp_path):
    import pandas as pd

    calls = []
    monkeypatch.setattr(formulas, "same", lambda a, b: calls.append((a, b)) or a == b)
    pairs = [("1", "1"), ("x", "y"), (None, "1"), ("9" * 300, "1")]
    batch = (pd.Series([a for a, _ in pairs] * 50, dtype=object), pd.Series([b for _, b in pairs] * 50, dtype=object))
    got = [list(s) for s in formulas._verdicts(iter([batch, batch]))]
    assert got == [[True, False, False, False] * 50] * 2
    assert len(calls) == 3 + 100  # long texts aren't held
    monkeypatch.undo()
    from rillstone.plans.rollout_queries import formula_equality

    spark.range(500).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert formula_equality(spark, str(tmp_path)).rdd.getNumPartitions() >= 32
