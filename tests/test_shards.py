"""Exact greedy shards against the sequential loop."""

import random

import numpy as np
import pytest

from rillstone.operators import shards

F = pytest.importorskip("pyspark.sql.functions")


def loop(sizes, cap):
    out, shard, used = [], 0, 0
    for k, n in enumerate(sizes):
        if k and used + n > cap:
            shard, used = shard + 1, 0
        used += n
        out.append(shard)
    return out


def sizes_of(rng, n, most, odd):
    return [rng.choice([1, most, 3 * most, 40 * most]) if rng.random() < odd else rng.randrange(1, most) for _ in range(n)]


@pytest.mark.parametrize(("wide", "fan", "cap", "odd"), [(1, 2, 50, 0.0), (1, 256, 10, 0.2), (2, 3, 30, 0.05), (16, 256, 40, 0.0)])
def test_shards_equal_the_loop(spark, monkeypatch, wide, fan, cap, odd):
    monkeypatch.setattr(shards, "WIDE", wide)
    monkeypatch.setattr(shards, "FAN", fan)
    rng = random.Random(cap)
    files = {"a": sizes_of(rng, 500, 20, odd), "b": [5] * 90, "c": [1000], "d": sizes_of(rng, 40, 20, odd), "e": [cap] * 5 + [cap + 1] * 3}
    rows = [(f, k * 3 - 7, n) for f, sizes in files.items() for k, n in enumerate(sizes)]
    rng.shuffle(rows)
    got = shards.greedy_shards(spark.createDataFrame(rows, "f string, k int, n int").repartition(3), "f", "k", F.col("n"), cap).collect()
    for f, sizes in files.items():
        assert [r["shard"] for r in sorted((r for r in got if r["f"] == f), key=lambda r: r["k"])] == loop(sizes, cap)


def test_chains_of_a_run():
    start, end = np.array([0, 4, 6, 20]), np.array([4, 6, 20, 21])
    follows, last, opened = shards._chains(start, end, 10)
    assert follows.tolist() == [2, 2, 3, 4] and last.tolist() == [3, 3, 3, 3] and opened.tolist() == [3, 3, 2, 1]


def test_no_row_and_one_row(spark):
    empty = spark.createDataFrame([], "f string, k int, n int")
    assert shards.greedy_shards(empty, "f", "k", F.col("n"), 5).count() == 0
    one = spark.createDataFrame([("a", 1, 99)], "f string, k int, n int")
    assert [r["shard"] for r in shards.greedy_shards(one, "f", "k", F.col("n"), 5).collect()] == [0]


def test_taken_indexes_are_skipped(spark):
    df = spark.range(6).select(shards.free_index(F.col("id"), [7, 5, 6, 9, 1, 7], 4).alias("i"))
    assert [r["i"] for r in df.collect()] == [4, 8, 10, 11, 12, 13]
    assert [r["i"] for r in spark.range(2).select(shards.free_index(F.col("id"), []).alias("i")).collect()] == [0, 1]
