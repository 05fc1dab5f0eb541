"""Recurrences over long sequences against the loop."""

import random

import pytest

from rillstone.operators import advantages as A
from rillstone.operators import scans

F = pytest.importorskip("pyspark.sql.functions")


def loop(values, gamma, follow=None, ahead=0.0, open_=None):
    out, y, v, o = [], 0.0, 0.0, False
    for i in range(len(values) - 1, -1, -1):
        y = values[i] + ((gamma * y + ahead * v) if o else 0.0)
        v, o = (follow[i] if follow else 0.0), (open_[i] if open_ else True)
        out.append(y)
    return out[::-1]


def sequences(rng, lengths, gaps):
    rows = []
    for key, n in lengths.items():
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 5]) if gaps else 1
            rows.append((key, at - (3 if gaps else 1), rng.random() - 0.4, rng.random(), rng.random() > 0.03))
    return rows


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("length", "fan"), [(1024, 64), (7, 2), (1, 3)])
@pytest.mark.parametrize("gamma", [0.9, 1.0, 0.0, 1e-30, 1.01])
def test_any_blocks_equal_the_loop(spark, monkeypatch, length, fan, gamma):
    monkeypatch.setattr(scans, "LENGTH", length)
    monkeypatch.setattr(scans, "FAN", fan)
    rng = random.Random(length)
    rows = sequences(rng, {1: 90, 2: 1, 3: 40}, gaps=True)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, at int, r double, v double, o boolean")
    got = scans.reverse_scan(df, "key", "at", F.col("r"), gamma, "y", follow=F.col("v"), ahead=0.7, open_=F.col("o")).collect()
    for key in (1, 2, 3):
        own = sorted(r for r in rows if r[0] == key)
        want = loop([r[2] for r in own], gamma, [r[3] for r in own], 0.7, [r[4] for r in own])
        near([r["y"] for r in sorted((r for r in got if r["key"] == key), key=lambda r: r["at"])], want)


def test_a_hundred_thousand_tokens(spark):
    """Far beyond the place where a power of the discount vanishes, in a table of which one sequence holds the most."""
    rng = random.Random(7)
    rows = sequences(rng, {1: 100_000, 2: 3}, gaps=False)
    df = spark.createDataFrame([(*r[:4], int(r[4])) for r in rows], "key int, at int, r double, v double, m int").repartition(4)
    one = [r for r in rows if r[0] == 1]
    r, v, o = ([x[k] for x in one] for k in (2, 3, 4))
    got = sorted((x for x in A.gae(df, "key", "at", "r", "v", 0.99, 0.95).collect() if x["key"] == 1), key=lambda x: x["at"])
    near([x["advantage"] for x in got], loop([a - b for a, b in zip(r, v, strict=True)], 0.99 * 0.95, v, 0.99))
    got = sorted((x for x in A.discounted_returns(df, "key", "at", "r", 0.9, mask="m").collect() if x["key"] == 1), key=lambda x: x["at"])
    near([x["returns"] for x in got], loop(r, 0.9, open_=o))


def test_a_long_sequence_is_spread_over_tasks(spark):
    df = spark.range(100_000).select((F.col("id") * 0).alias("key"), F.col("id").alias("at"), F.lit(1.0).alias("r"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scans.reverse_scan(df, "key", "at", F.col("r"), 0.5, "y").withColumn("task", F.spark_partition_id())
        got = out.groupBy("task").agg(F.count("y").alias("n"), F.max("y").alias("most")).collect()
        assert len(got) == 4 and max(r["n"] for r in got) < 50_000, got
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_order_that_is_no_number(spark):
    df = spark.createDataFrame([("a", f"{i:03}", float(i)) for i in range(30)], "key string, at string, r double")
    got = sorted(scans.reverse_scan(df, "key", "at", F.col("r"), 0.5, "y").collect(), key=lambda r: r["at"])
    near([r["y"] for r in got], loop([float(i) for i in range(30)], 0.5))


def test_no_row(spark):
    df = spark.createDataFrame([], "key int, at int, r double, v double, m int")
    assert A.gae(df, "key", "at", "r", "v", 0.99, 0.95, mask="m", whiten=True).count() == 0
    assert A.discounted_returns(df, "key", "at", "r", 0.9, mask="m").count() == 0
