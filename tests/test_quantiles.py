"""Exact quantiles and mergeable log-sum-exp against plain computation."""

import math
import random

import pytest

from rillstone.operators import quantiles as Q

F = pytest.importorskip("pyspark.sql.functions")
SHARES = [0.0, 0.1, 0.25, 0.5, 0.5001, 0.9, 1.0]


def builtin(df):
    return df.agg(F.percentile("x", F.array(*[F.lit(q) for q in SHARES]))).first()[0]


@pytest.mark.parametrize("case", ["spread", "ties", "powers", "near", "one", "huge"])
def test_quantiles_equal_the_built_in(spark, case):
    rng = random.Random(7)
    values = {
        "spread": [rng.gauss(0, 100) for _ in range(3001)],
        "ties": [float(rng.choice([1, 1, 1, 2, 5])) for _ in range(2000)],
        "powers": [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1000, 1000) for _ in range(500)],
        "near": [math.nextafter(1.0, 2.0), 1.0, math.nextafter(1.0, 0.0), 5e-324, 0.0, -5e-324],
        "one": [3.5],
        "huge": [-1.7e308, 1.7e308, 1.6e308, 0.0, -0.0],
    }[case]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    assert Q.exact_quantiles(df, "x", SHARES) == pytest.approx(builtin(df), rel=1e-12)
    few = Q.order_statistics(df, "x", list(range(min(len(values), 5))), slices=3)
    assert [few[k] for k in sorted(few)] == sorted(values)[:5]


def test_quantiles_of_odd_tables(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert Q.exact_quantiles(none, "x", [0.5]) == [None] and Q.exact_quantiles(none.limit(0), "x", [0.5, 1.0]) == [None, None]
    odd = spark.createDataFrame([(v,) for v in [math.inf, -math.inf, math.nan, 1.0, 2.0]], "x double")
    got = Q.order_statistics(odd, "x", [0, 1, 2, 3, 4])
    assert [got[k] for k in range(4)] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])
    with pytest.raises(ValueError):
        Q.exact_quantiles(odd, "x", [1.5])
    with pytest.raises(ValueError):
        Q.order_statistics(odd, "x", [5])


def test_quantile_is_read_in_few_rows(spark):
    """A hundred thousand distinct values: the driver gets slices, and two passes are enough."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    assert Q.exact_quantiles(df, "x", [0.5, 0.99]) == builtin_of(df, [0.5, 0.99])


def builtin_of(df, shares):
    return df.agg(F.percentile("x", F.array(*[F.lit(q) for q in shares]))).first()[0]


def plain_entropy(xs):
    top = max(xs)
    z = sum(math.exp(x - top) for x in xs)
    p = [math.exp(x - top) / z for x in xs]
    return -sum(q * math.log(q) for q in p if q > 0), top + math.log(z) - sum(xs) / len(xs)


def test_chunked_entropies_equal_the_array_form(spark):
    from rillstone.operators import logits as L

    rng = random.Random(3)
    rows = {k: [rng.gauss(0, spread) + shift for _ in range(n)] for k, (spread, shift, n) in enumerate([(1, 0, 100), (300, 0, 333), (1, 1e6, 50), (1, -5000, 64), (0, 0, 1), (5000, 0, 40)])}
    df = spark.createDataFrame(list(rows.items()), "pos long, v array<double>")
    for size in (1, 7, 1000):
        out = L.chunked_entropies(L.in_chunks(df, ["pos"], "v", size).repartition(5), ["pos"], "v").collect()
        got = {r["pos"]: (r["entropy"], r["self_certainty"]) for r in out}
        assert set(got) == set(rows)
        for k, xs in rows.items():
            assert got[k] == pytest.approx(plain_entropy(xs), rel=1e-9, abs=1e-8)


def test_chunked_entropies_of_odd_logits(spark):
    from rillstone.operators import logits as L

    inf, nan = math.inf, math.nan
    rows = [(1, [0.0, None]), (1, [-inf, 0.0]), (2, [-inf]), (2, []), (3, [nan, 1.0]), (4, [None]), (5, None), (6, [inf, 1.0]), (None, [1.0]), (None, [1.0]), (7, [-inf, -inf]), (7, [2.0])]
    out = L.chunked_entropies(spark.createDataFrame(rows, "pos long, v array<double>"), ["pos"], "v").collect()
    got = {r["pos"]: (r["entropy"], r["self_certainty"]) for r in out}
    assert set(got) == {1, 2, 3, 6, None, 7}
    assert got[1] == (pytest.approx(math.log(2)), inf) and got[2] == (None, None) and got[None] == (pytest.approx(math.log(2)), pytest.approx(math.log(2))) and got[7] == (pytest.approx(0), inf)
    assert all(math.isnan(v) for k in (3, 6) for v in got[k])
    assert L.chunked_entropies(spark.createDataFrame([], "pos long, v array<double>"), ["pos"], "v").collect() == []
