"""Sampled rollouts against a plain walker, and their shares against the policy."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from rillstone.operators import walks as W

F = pytest.importorskip("pyspark.sql.functions")
SCORES = "position string, move string, child string, score double"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def number(seed, *keys):
    return int(md5(":".join(map(str, (seed, *keys))))[:12], 16)


def laid_out(moves, temperature):
    """[(low, high, move, child)] of one position, one move after the other."""
    peak = max(s for s, _ in moves.values())
    order = sorted(moves, key=lambda m: (md5(m), m))
    weights = [max(1, math.floor(math.exp((moves[m][0] - peak) / temperature) * 2**30)) for m in order]
    out, at = [], 0
    for m, w in zip(order, weights, strict=True):
        out.append((at * 2**48 // sum(weights), (at + w) * 2**48 // sum(weights), m, moves[m][1]))
        at += w
    return out


def plain_rollouts(roots, rows, n_candidates, n_walks, depth, temperature, seed):
    table = defaultdict(dict)
    for p, m, c, s in rows:
        table[p][m] = max(table[p].get(m, (-math.inf, "")), (s, c))
    laid = {p: laid_out(ms, temperature) for p, ms in table.items()}
    out = set()
    for tree, root in roots:
        noisy = sorted((-(s / temperature - math.log(-math.log((number(seed, tree, m) + 0.5) / 16**12))), m, c) for m, (s, c) in table.get(root, {}).items())
        for draw, (_, m, c) in enumerate(noisy[:n_candidates], 1):
            for walk in range(n_walks):
                at, step = c, 0
                out.add((tree, draw, walk, 0, m, c))
                while step + 1 < depth and at in laid:
                    step += 1
                    u = number(seed, tree, draw, walk, step)
                    _, _, move, at = next(x for x in laid[at] if x[0] <= u < x[1])
                    out.add((tree, draw, walk, step, move, at))
    return out


def graph(seed, positions=30, most=9):
    rng = random.Random(seed)
    rows = []
    for p in range(positions):
        for m in range(rng.randrange(0, most)):
            rows.append((f"p{p}", f"m{m}", f"p{rng.randrange(positions)}", rng.gauss(0, 3)))
    return rows + rows[:5]


def rows_of(df):
    return [tuple(r) for r in df.select("tree", "draw", "walk", "step", "move", "position").collect()]


@pytest.mark.parametrize("seed", [0, 7])
def test_rollouts_equal_a_plain_walker(spark, seed):
    rows = graph(seed)
    roots = [(t, f"p{t % 30}") for t in range(40)]
    got = rows_of(W.rollouts(spark.createDataFrame(roots, "tree long, position string"), spark.createDataFrame(rows, SCORES).repartition(5), 3, 4, 6, 2.0, seed))
    assert len(got) == len(set(got))
    assert set(got) == plain_rollouts(roots, rows, 3, 4, 6, 2.0, seed)


def test_intervals_tile_the_span(spark):
    rng = random.Random(5)
    rows = [("wide", f"m{i}", "x", rng.gauss(0, 2)) for i in range(6000)] + [("one", "m", "x", 1e300)] + [("far", "a", "x", 1e6), ("far", "b", "x", -1e6)]
    laid = W.intervals(spark.createDataFrame(rows, SCORES), 1.5)
    assert laid.groupBy("position", "bin").agg(F.max("low")).filter("bin < 0 OR bin > 31").isEmpty()
    by = defaultdict(set)
    for r in laid.collect():
        assert r["low"] >> W.SHIFT <= r["bin"] <= (r["high"] - 1) >> W.SHIFT
        by[r["position"]].add((r["low"], r["high"], r["move"]))
    for p in ("wide", "one", "far"):
        spans = sorted(by[p])
        assert spans[0][0] == 0 and spans[-1][1] == 2**48 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(by["wide"]) == 6000 and len(by["far"]) == 2
    assert by["wide"] == {x[:3] for x in laid_out({m: (s, c) for p, m, c, s in rows if p == "wide"}, 1.5)}


def test_shares_are_near_the_policy(spark):
    rows = [("hub", m, "end", s) for m, s in (("a", 0.0), ("b", 1.0), ("c", 2.0))] + [("root", "go", "hub", 0.0)]
    got = rows_of(W.rollouts(spark.createDataFrame([(1, "root")], "tree long, position string"), spark.createDataFrame(rows, SCORES), 1, 20_000, 5, 1.0, 3))
    taken = Counter(r[4] for r in got if r[3] == 1)
    total = sum(math.exp(s) for s in (0, 1, 2))
    assert sum(taken.values()) == 20_000 and max(r[3] for r in got) == 1
    for m, s in (("a", 0), ("b", 1), ("c", 2)):
        assert taken[m] / 20_000 == pytest.approx(math.exp(s) / total, abs=0.015)


def test_first_moves_are_distinct_and_follow_the_policy(spark):
    rows = spark.createDataFrame([("r", m, "x", s) for m, s in (("a", 0.0), ("b", math.log(3.0)), ("c", 0.0))], SCORES)
    roots = spark.range(4000).select(F.col("id").alias("tree"), F.lit("r").alias("position"))
    got = W.candidates(roots, rows, 2).collect()
    seen = defaultdict(list)
    for r in sorted(got, key=lambda r: r["draw"]):
        seen[r["tree"]].append(r["move"])
    assert len(seen) == 4000 and all(len(set(ms)) == 2 for ms in seen.values())
    firsts = Counter(ms[0] for ms in seen.values())
    second = Counter(ms[1] for ms in seen.values() if ms[0] == "b")
    assert firsts["b"] / 4000 == pytest.approx(0.6, abs=0.03) and second["a"] / sum(second.values()) == pytest.approx(0.5, abs=0.04)
    assert len(W.candidates(roots.limit(1), rows, 9).collect()) == 3


def test_reruns_agree_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = graph(2) + [("p1", None, "p2", 1.0), (None, "m1", "p2", 1.0), ("p1", "bad1", "p2", None), ("p1", "bad2", "p2", nan), ("p1", "bad3", "p2", inf), ("p1", "leaf", None, 5.0)]
    roots = [(1, "p1", 3), (1, "p9", 2), (2, None, 3), (None, "p1", 3), (3, "nowhere", 3), (4, "p1", None), (5, "p1", 0), (6, "p1", 2)]
    df, table = spark.createDataFrame(roots, "tree long, position string, n int"), spark.createDataFrame(rows, SCORES).withColumn("bin", F.lit(9)).withColumn("low", F.lit("x"))
    got = rows_of(W.rollouts(df, table, 2, "n", 5, 2.0, 1))
    assert sorted(map(repr, got)) == sorted(map(repr, rows_of(W.rollouts(df.repartition(7), table.repartition(3), 2, "n", 5, 2.0, 1))))
    assert {r[0] for r in got} == {1, 6} and {r[2] for r in got if r[0] == 1} == {0, 1, 2} and not any(r[4].startswith("bad") for r in got)
    assert not [r for r in got if r[3] and r[:3] in {g[:3] for g in got if g[3] == r[3] - 1 and g[5] is None}]
    none = W.rollouts(df, table.limit(0), 2, "n", 5)
    assert none.columns == ["tree", "draw", "walk", "step", "move", "position"] and none.collect() == []
    assert W.rollouts(df.limit(0), table, 2, 3, 4).collect() == []
    paths = {(r["tree"], r["draw"], r["walk"]): r["path"] for r in W.lines(W.rollouts(df, table, 2, "n", 5, 2.0, 1)).collect()}
    assert paths == {k: [r[4] for r in sorted(got, key=lambda r: r[3]) if r[:3] == k] for k in {r[:3] for r in got}}
    with pytest.raises(ValueError):
        W.intervals(table, 0.0)
    with pytest.raises(ValueError):
        W.rollouts(df, table, 0, 1, 1)


def test_policies_are_dealt_once_for_all_rounds(spark, monkeypatch):
    rows = [(f"p{k}", f"m{j}", f"p{(k * 3 + j) % 20}", float(j)) for k in range(20) for j in range(4)]
    laid = W.written(W.intervals(spark.createDataFrame(rows, "position string, move string, child string, score double")), "test-laid")
    plans, kept = [], W.written
    monkeypatch.setattr(W, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    starts = spark.range(50).selectExpr("id AS tree", "concat('p', id % 20) AS position")
    assert W.walks(starts, laid, ["tree"], 3).count() == 150
    assert len(plans) == 3 and all("InMemoryTableScan" in p for p in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
