"""What SQL can't express of the move, stage, tree, row and loader operators: brute force, examples and round trips."""

import json
import math
import random

import numpy as np
import pytest

from rillstone.functions import distributions as D
from rillstone.functions import final_answers as N
from rillstone.functions import lan_tokens as L
from rillstone.functions import moves as M
from rillstone.functions import notation, rules
from rillstone.operators import batch as B
from rillstone.operators import grading as G
from rillstone.operators import growth as W
from rillstone.operators import lookups
from rillstone.operators import prep as P
from rillstone.operators import shards, stages, states
from rillstone.operators import training_rows as R
from rillstone.operators import trees as T
from rillstone.plans import named
from rillstone.sources import loaders
from rillstone.streaming import metrics as S

F = pytest.importorskip("pyspark.sql.functions")


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def texts(*ts):
    return [F.lit(t) for t in ts]


# moves


def test_moves_in_text(spark):
    c = F.lit
    got = one(
        spark, M.first_move(c("1. Pe2e4 Pe7e5")), M.first_move(c("  ")), M.first_move(c("1. hello")), M.last_move(c("Pe2e4 x O-O+ 3.")), M.coordinates(c("Pe7e8=Q+")), M.coordinates(c("0-0-0#")),
        M.coordinates(c("Bb2xc3+")), M.coordinates(c("e2e4")), M.to_uci(c("O-O"), False), M.to_uci(c("Pe7xd8=N#")), M.to_uci(c("e2e4")), M.normal_move(c(" Nf 3+# ")), M.first_listed(c(" , a,b")),
    )
    assert tuple(got) == ("Pe2e4", "", None, "O-O+", "e7e8q", "castle_queenside", "b2c3", "e2e4", "e8g8", "e7d8n", None, "nf3", " a")
    after = one(spark, M.move_after_thought(c("<T> Pa2a3 </T> 1. Pe2e4")), M.move_after_thought(c("a </T> b </T> Pe2e4")), M.move_after_thought(c("a </T> b </T> Pe2e4"), False), M.move_after_thought(c("a </T>")))
    assert [tuple(x) for x in after] == [("Pe2e4", True), (None, False), ("Pe2e4", True), (None, True)]
    own = one(spark, M.own_moves(c("<T> x </T> Pe2e4 <call_env> Pe7e5 Ng1f3 <call_env> none <call_env> Pa7a6")))[0]
    assert own == ["Pe2e4", "Ng1f3", None]


def test_boundary_is_the_shortest_prefix(spark):
    rng = random.Random(1)
    pieces = ["P", "e2", "e4", " ", "Pd2", "d4", "O-", "O", "1.", " N", "g1f3 ", "x"]
    rows = [[rng.choice(pieces) for _ in range(rng.randrange(1, 9))] for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, tokens array<string>")
    for r in df.select("i", M.boundary(F.col("tokens")).alias("b")).collect():
        want = (None, None)
        for end in range(1, len(rows[r["i"]]) + 1):
            hits = [w for w in "".join(rows[r["i"]][:end]).split() if __import__("re").match(M.MOVE, w)]
            if hits:
                want = (end, hits[0])
                break
        assert tuple(r["b"]) == want, rows[r["i"]]


def test_grades(spark):
    c = F.lit
    plain = G.one_turn(c("1. Pe2e4 Pe7e5 2. Ng1f3 Nb8c6"), F.array(*texts("e2e4", "xx", "g1f3")), "plain")
    wrong = G.one_turn(c("Pe2e4 Pe7e5"), F.array(*texts("e2e4", "xx", "g1f3")), "plain")
    turns = G.several_turns(c("</T> Pe2e4 <call_env> a Ng1f3 <call_env>"), F.array(*texts("e2e4", "g1f3")))
    got = one(spark, plain["score"], wrong["score"], turns["score"], turns["first_move_score"], G.several_turns(c("no call"), F.array(*texts("e2e4")))["score"])
    assert list(got) == [1.0, 0.0, 1.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        G.one_turn(c(""), c(""), "other")
    rows = spark.createDataFrame([(rules.START, "e2e4"), (rules.START, "e2e5"), ("bad", "e2e4"), (None, None)], "fen string, m string")
    assert [r["legal"] for r in G.with_legality(rows, "fen", "m").collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="labels differ"):
        G.constant_per_group(spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "g int, l int, m double"), "g", "l", ["m"]).collect()


# boards


def test_boards(spark):
    fen = "8/P6k/8/8/8/8/8/K7 w - - 0 1"
    df = spark.createDataFrame([(rules.START, ["e2e4", "e7e5", "e1e5"]), (fen, ["a7a8"])], "fen string, m array<string>")
    got = df.select(notation.positions_along("fen", "m").alias("p"), notation.children_of("fen", "m").alias("c"), notation.white_to_move("fen").alias("w"), notation.resolved("fen", F.get("m", F.lit(0))).alias("r")).collect()
    assert len(got[0]["p"]) == 3 and got[0]["p"][0] == rules.START and [x["move"] for x in got[0]["c"]] == ["e2e4"]
    assert [x["move"] for x in got[1]["c"]] == ["a7a8q"] and got[1]["r"] == "a7a8q" and got[1]["w"]
    assert notation.positions_needed(df, "fen", "m").count() == 4
    game = "[Event \"x\"]\n\n1. e4 e5 2. Nf3 Nc6 1-0"
    target = rules.replay(["e4", "e5"])[1][-1].fen()
    g = spark.createDataFrame([(game, target, "Bb5 a6"), (game, fen, "Bb5"), (None, None, None)], "g string, f string, m string")
    rows = g.select(notation.line_until("g", "f").alias("l"), notation.after_trigger("g", "m").alias("t"), notation.as_uci(F.lit(rules.START), F.lit("Nf3")).alias("u")).collect()
    assert rows[0]["l"] == "1. e4 e5" and rows[1]["l"] is None and rows[0]["u"] == "g1f3"
    assert tuple(rows[0]["t"]) == ("1. e4 e5 2. Nf3 Nc6 3. Bb5", "a6") and tuple(rows[1]["t"]) == (None, None)


def test_target_presence(spark):
    rows = [(rules.START, "Pe2e4", ["Pe2e4", "Pd2d4"], ["Pd2d4"]), (rules.START, "Pe2e4", ["Pd2d4"], ["Pe2e4"]), (rules.START, None, ["Pd2d4"], ["Pe2e4"]), (rules.START, "Pe2e4", ["Pe2e5"], ["O-O"])]
    df = spark.createDataFrame(rows, "fen string, target string, roots array<string>, every array<string>")
    got = notation.target_presence(df, "fen", "target", "roots", "every").collect()
    assert [(r["in_root"], r["anywhere"]) for r in got] == [(1, 0), (0, 1), (None, None), (0, 0)]


# stages


def test_alpha_of_each_state(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for i in range(20):
        p = rng.dirichlet(np.ones(6))
        alpha = float(rng.uniform(0.2, 3))
        q = p**alpha / (p**alpha).sum()
        rows.append((i, p.tolist(), q.tolist()))
        want.append(alpha)
    got = stages.alpha_per_state(spark.createDataFrame(rows, "s int, p array<double>, q array<double>"), "s").orderBy("s").collect()
    assert all(abs(r["alpha"] - a) < 1e-3 and r["residual_jsd"] < 1e-6 and (r["explained"] is None or r["explained"] > 0.99) for r, a in zip(got, want, strict=True))
    assert states.at_boundary(4.97) and not states.at_boundary(1.0)


def test_collapse_is_the_nearest_trace(spark):
    rng = np.random.default_rng(2)
    jsd = lambda a, b: 0.5 * sum(x * math.log(x / m) for x, m in zip(a, (a + b) / 2, strict=True) if x > 1e-12) + 0.5 * sum(x * math.log(x / m) for x, m in zip(b, (a + b) / 2, strict=True) if x > 1e-12)
    new, old, traces, want = [], [], [], []
    for s in range(8):
        vectors = [np.where(rng.random(5) < 0.4, 0, rng.random(5)) + np.eye(5)[k % 5] * 0.1 for k in range(4)]
        vectors = [v / v.sum() for v in vectors]
        target, mean = vectors.pop(), sum(vectors) / len(vectors)
        new += [(s, f"a{k}", float(x)) for k, x in enumerate(target) if x > 0]
        old += [(s, f"a{k}", float(x)) for k, x in enumerate(mean) if x > 0]
        for t, v in enumerate(vectors):
            traces += [(s, t, f"a{k}", float(x)) for k, x in enumerate(v) if x > 0]
        d = [jsd(target, v) for v in vectors]
        want.append((jsd(target, mean), min(d), int(np.argmin(d)), f"a{int(np.argmax(vectors[int(np.argmin(d))]))}"))
    kind = "s int, a string, g double"
    truth = spark.createDataFrame([(s, "a0") for s in range(8)], "s int, truth string")
    got = stages.trace_collapse(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind), spark.createDataFrame(traces, "s int, t int, a string, p double"), truth, "s", "t", "a").orderBy("s").collect()
    for r, w in zip(got, want, strict=True):
        assert (r["d_marginal"], r["d_trace"]) == pytest.approx(w[:2], abs=1e-9) and (r["nearest"], r["nearest_mode"]) == w[2:] and r["mode_is_truth"] == (w[3] == "a0")


def test_truth_that_is_no_action(spark):
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)], "s int, a string, g double")
    truth = spark.createDataFrame([(1, "c"), (2, "a")], "s int, truth string")
    got = {r["s"]: (r["pi"], r["rank"], r["margin"]) for r in stages.truth_metrics(p, truth, ["s"], "s", "a", "g").collect()}
    assert got[1] == (0.0, 9999, None) and got[2][:2] == (1.0, 1) and got[2][2] == pytest.approx(-math.log(1e-12))
    assert one(spark, stages.parsed_config(F.lit(stages.config_id("6p5e18", "50m", "0.2", "1"))))[0] == ("6p5e18", "50m", "0.2", "1")


# trees


def grown(scores, position, budget, depth=4, most=3, stop=0.6, temperature=100.0, eps=1e-6):
    """The recursion that ``grow`` unrolls by level."""
    out = []

    def expand(position, budget, path, straight):
        moves = sorted(scores.get(position, []), key=lambda m: (-m[2], m[0]))[:most]
        if budget <= 0 or len(path) >= depth or not moves:
            if path:
                out.append(tuple(path))
            return
        e = [math.exp((m[2] - moves[0][2]) / temperature) for m in moves]
        p = [x / sum(e) for x in e]
        h = -sum(x * math.log(x) for x in p if x > 0)
        if path and (straight or h < stop):
            expand(moves[0][1], budget - 1, [*path, moves[0][0]], True)
            return
        n = len(moves)
        share = min(max(h / math.log(n), 0), 1) if n > 1 else 0
        wide = moves if not path else moves[: max(1, round(1 + share * (n - 1)))]
        spread = float(np.std([m[3] for m in wide])) + eps
        w = [math.sqrt(abs(m[3] - m[2]) / spread + eps) for m in wide]
        units = [math.floor(x / sum(w) * (budget - 1)) for x in w]
        for k in sorted(range(len(w)), key=lambda k: (-w[k], k))[: budget - 1 - sum(units)]:
            units[k] += 1
        for m, u in zip(wide, units, strict=True):
            expand(m[1], u, [*path, m[0]], False)

    expand(position, budget, [], False)
    return sorted(out)


def test_growth_against_recursion(spark):
    rng = random.Random(3)
    scores = {f"p{i}": [(f"m{k}", f"p{rng.randrange(40)}" if rng.random() < 0.8 else "end", float(rng.randrange(-200, 200)), float(rng.randrange(-200, 200))) for k in range(rng.randrange(1, 5))] for i in range(40)}
    table = spark.createDataFrame([(p, *m) for p, ms in scores.items() for m in ms], "position string, move string, child string, work double, ref double")
    roots = [(t, f"p{rng.randrange(40)}", rng.randrange(0, 30)) for t in range(12)]
    got = W.grow(spark.createDataFrame(roots, "tree int, position string, budget int"), table, most=3, depth=4, stop_entropy=0.6)
    found = {}
    for r in got.collect():
        found.setdefault(r["tree"], []).append(tuple(r["path"]))
    for tree, position, budget in roots:
        assert sorted(found.get(tree, [])) == grown(scores, position, budget), (tree, position, budget)


def test_synthesis(spark):
    scores = spark.createDataFrame([("r", "a", "p1", 50.0, 40.0), ("r", "b", "p2", 40.0, 90.0), ("p1", "c", "p3", 10.0, 0.0), ("p2", "d", "p4", 5.0, 5.0)], "position string, move string, child string, work double, ref double")
    leaf = spark.createDataFrame([("p3", -400.0, None, False, None), ("p4", 400.0, None, False, None)], "position string, cp double, mate_in int, over boolean, winner_is_root boolean")
    roots = spark.createDataFrame([(1, "r", 10, "e4"), (2, "nowhere", 10, "d4")], "tree int, position string, budget int, ctx string")
    got = {r["tree"]: r for r in W.synthesise(roots, scores, leaf, "ctx", depth=2).collect()}
    assert got[1]["move"] == "b" and got[1]["label"] == 1 and got[1]["n_lines"] == 2
    assert got[1]["text"] == "e4 <T> a c <result>-1</result> <sep> b d <result>+1</result> </T> b" and got[2]["text"] == ""


def test_row_metrics(spark):
    df = spark.createDataFrame([(1, "a b <sep> a c <sep> d </T> a"), (2, "nothing"), (3, "a </T>")], "k int, o string")
    got = {r["k"]: r for r in T.row_metrics(df, "k", "o").collect()}
    assert (got[1]["candidate_count"], got[1]["num_nodes"], got[1]["max_depth"], got[1]["visits"], got[1]["consistency"]) == (2, 4, 2, 5, 1.0)
    assert got[1]["branching"] == pytest.approx(2.0) and got[1]["leaves_per_depth"] == 1.5 and got[1]["revisit_rate"] == pytest.approx(0.2)
    assert (got[2]["num_nodes"], got[2]["consistency"], got[2]["n_chars"]) == (0, 1.0, 0) and got[3]["num_nodes"] == 1


def test_labelled_trees_and_order(spark):
    lines = spark.createDataFrame([(1, ["a", "x"]), (1, ["a", "y"]), (1, ["b", "z"])], "tree int, path array<string>")
    ends = spark.createDataFrame([(1, ["a", "x"], 500.0, None, False, None), (1, ["a", "y"], -500.0, None, False, None), (1, ["b", "z"], 10.0, None, True, True)], "tree int, path array<string>, cp double, mate_in int, over boolean, winner_is_root boolean")
    got = {r["move"]: (r["value"], r["label"]) for r in W.labelled_trees(lines, ends).collect()}
    assert got == {"a": (-500.0, -1), "b": (10.0, 1)}
    text = W.lines_in_order(lines.join(ends.select("tree", "path", "cp"), ["tree", "path"]), "cp").first()["text"]
    assert text == "a y <sep> b z <sep> a x"
    a = F.array(*texts("a"))
    assert list(one(spark, W.is_ancestor(a, F.array(*texts("a", "x"))), W.is_ancestor(a, a), W.is_ancestor(a, F.array(*texts("b", "x"))), W.lines_for_budget(F.lit(17), 5))) == [True, False, False, 3]


def test_slots_round_trip(spark):
    df = spark.createDataFrame([(1, ["a", "b"], 2), (2, ["c"], 3)], "pos int, c array<string>, n int")
    slots = W.slots(df, "pos", "c", "n", 4)
    assert slots.count() == 8 and slots.filter("pos is null").count() == 1
    texts_ = slots.withColumn("text", F.concat_ws("-", F.coalesce("candidate", F.lit("?")), F.coalesce(F.col("line").cast("string"), F.lit("?")))).select("slot", "text")
    got = {(r["pos"], r["candidate"]): r["lines"] for r in W.regrouped(texts_, slots, "pos").collect()}
    assert got == {(1, "a"): ["a-0", "a-1"], (1, "b"): ["b-0", "b-1"], (2, "c"): ["c-0", "c-1", "c-2"]}


# rows


def test_reply_mask(spark):
    # 9 call, 1-2 move starts, 8 structural, 5 equals; labels are inputs shifted
    tokens = [1, 30, 31, 9, 2, 40, 41, 5, 1, 1, 50, 51, 9, 2, 60, 8, 7]
    df = spark.createDataFrame([(tokens[:-1], tokens[1:])], "x array<bigint>, y array<bigint>")
    got = df.select(R.reply_mask(9, {1, 2}, {8}, 5)("x", "y").alias("l")).first()["l"]
    # after the call: piece 2, squares, equals and the promotion's piece are the reply; the next 1 starts the model's move
    assert got == [30, 31, 9, -100, -100, -100, -100, -100, 1, 50, 51, 9, -100, -100, 8, 7]


def test_chat_rows_cut(spark):
    x, y = F.array(*[F.lit(k) for k in (1, 2, 3)]), F.array(*[F.lit(k) for k in (4, 5, 6)])
    left, right = one(spark, R.chat_row(x, y, 4, cut="left"), R.chat_row(x, y, 4))
    assert left["input_ids"] == [3, 4, 5, 6] and right["input_ids"] == [1, 2, 3, 4] and right["loss_mask"] == [0, 0, 1, 0]
    with pytest.raises(Exception, match="sequence length"):
        spark.range(1).select(R.chat_row(x, y, 4, cut="error")).collect()


def test_ids_of_thoughts(spark):
    vocab = L.vocabulary(specials=("<T>", "</T>", "<best>"))
    text = F.lit("<T> e2 unknownword </T>")
    ids = one(spark, R.trace_ids(text, vocab, L.move_tokens(text)), R.trace_ids(F.lit("Pe2e4"), vocab, L.move_tokens(F.lit("Pe2e4"))))
    shown = {k: w for w, k in vocab.items()}
    assert [shown[i] for i in ids[0]][1:-1] == ["<T>", "e2", "<unk>", "</T>"] and [shown[i] for i in ids[1]][1:-1] == ["P", "e2", "e4"]
    assert R.special_ids(vocab, ("<T>", "<best>")).keys() == {"<T>", "<best>"}
    with pytest.raises(ValueError, match="not enabled"):
        R.special_ids(vocab, ("<call_env>",))


def test_budgeted_thinking(spark):
    run = S.budgeted(thought_end=1, separator=2, call=3, eos=0, budget=4, answer=3, most_calls=2)
    rows = [[7, 1, 7, 7, 5, 3, 6, 3, 9], [7, 0], [7, 7, 7, 1, 5, 5, 5, 5], [], [7, 7, 7, 7, 5, 0, 5]]
    got = [tuple(r["x"]) for r in spark.createDataFrame([(r,) for r in rows], "r array<bigint>").select(run("r").alias("x")).collect()]
    assert got == [([7, 2, 7, 7, 1], [5, 3, 6], 1, "budget"), ([7, 1], [0], 0, "end"), ([7, 7, 7, 1], [5, 5, 5], 0, "budget"), ([1], [], 0, "recorded"), ([7, 7, 7, 7, 1], [5, 0], 0, "end")]


# answers


def test_cut_answers(spark):
    cases = {
        "So the final answer: 42": (True, "42"), "we get x = 7 is the answer": (True, "7"), "the answer is \\boxed{\\frac{1}{2}}": (True, "\\frac{1}{2}"), "no digits here": (False, "no digits here"), "12": (False, "12"),
    }
    got = one(spark, *[N.cut_answer(F.lit(t)) for t in cases])
    assert [tuple(x) for x in got] == list(cases.values())
    c = F.lit
    rest = one(spark, N.boxed(c("\\boxed{a{b}c} x \\boxed{open")), N.boxed(c("none")), N.boxed_or_typed(c("\\boxed{'x y'}")), N.normalised(c("x = $1,234$ units")), N.any_check(lambda t, g: t == g, lambda t, g: F.lit(None))(c("a"), c("a")))
    assert list(rest) == [None, None, "x y", "1234", True]


# batches and shards


def test_batch_shapes(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "row long, v string")
    assert [r["v"] for r in B.item(df, slice(-2, None), 6).orderBy("row").collect()] == ["v4", "v5"]
    assert B.item(df, -1, 6).first()["v"] == "v5" and [r["v"] for r in B.item(df, [2, 2, 0], 6).orderBy("row").collect()] == ["v2", "v2", "v0"]
    with pytest.raises(IndexError):
        B.item(df, 6, 6)
    with pytest.raises(KeyError):
        B.project(df, ["nope"])
    with pytest.raises(ValueError):
        B.renamed(df, ["v"], [])
    with pytest.raises(ValueError):
        B.rows_concat([df, df.drop("v")])
    with pytest.raises(ValueError):
        B.mini_batches(df, 6, 4, 1)
    assert B.merged({"a": 1}, {"a": 1, "b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        B.merged({"a": 1}, {"a": 2})
    parts = B.checked_partitions([5, 1, 4, 2, 3, 3], 3, True)
    assert sorted(B.balanced_order(parts)) == list(range(6)) and all(len(p) == 2 for p in parts)
    assert B.useful_rows(df, df.limit(2), "v", 3) is None and B.steps_for_budget(17, 5) == 3
    plain = B.mini_batches(df, 6, 3, 2).orderBy("epoch", "row").collect()
    assert [(r["epoch"], r["mini_batch"], r["place"]) for r in plain][:4] == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0)]


def test_greedy_shards_restart_by_file(spark):
    rng = random.Random(5)
    rows = [(f, k, rng.randrange(1, 30)) for f in "ab" for k in range(200)]
    got = shards.greedy_shards(spark.createDataFrame(rows, "f string, k int, n int").repartition(5), "f", "k", F.col("n"), 50).collect()
    found = {(r["f"], r["k"]): r["shard"] for r in got}
    for f in "ab":
        used, shard = 0, 0
        for _, k, n in [r for r in rows if r[0] == f]:
            if used and used + n > 50:
                used, shard = 0, shard + 1
            used += n
            assert found[f, k] == shard


def test_escaped_lines(spark):
    ts = ["plain", 'quote " and \\ back', "line\nbreak\ttab", "é ü 日本", "x" * 60]
    rows = spark.createDataFrame([(t,) for t in ts], "t string").select("t", P.escaped_length("t").alias("n")).collect()
    assert [r["n"] for r in rows] == [len(json.dumps(t, ensure_ascii=False)[1:-1]) + 1 for t in ts]


def test_zipped_and_ordered_union(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"], ["x", "y"], ["y", "z"])], "i array<int>, s array<string>, a array<string>, b array<string>")
    r = df.select(lookups.zipped("i", "s").alias("z"), lookups.ordered_union(F.col("a"), F.col("b")).alias("u")).first()
    assert [tuple(x) for x in r["z"]] == [(1, "a"), (2, "b")] and r["u"] == ["x", "y", "z"]


# loaders


def test_loaders(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(0, "test_B1", 1), (1, "test_B1", 2), (0, "train", 3)], "turn int, data_source string, x int").write.parquet(f"{root}/scores")
    assert [r["x"] for r in loaders.first_turn_scores(spark, f"{root}/scores", ("turn", "data_source", "x")).collect()] == [1]
    assert loaders.first_turn_scores(spark, f"{root}/none", ("x",)) is None
    loaders.write_text_column(spark.createDataFrame([(" a ",), (None,), ("  ",), ('b "q", c',)], "t string").coalesce(1), "t", f"{root}/flat")
    lines = spark.read.text(f"{root}/flat").collect()
    assert sorted(r[0] for r in lines) == ['"b ""q"", c"', "a"]
    for name, ids in (("shard_0", [1, 2, 3]), ("shard_1", [4, 5])):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "0.npy", np.asarray(ids, dtype=np.uint32))
    assert [p.rsplit("/", 2)[1] for p in loaders.files_in_order(spark, root)] == ["shard_0", "shard_1"]
    assert sorted(r["ids"] for r in loaders.token_files(spark, root, 2).collect()) == [[1, 2], [4, 5]]
    (tmp_path / "f").mkdir()
    for n in ("b.json", "a.jsonl", "c.txt"):
        (tmp_path / "f" / n).write_text("{}")
    assert [p.rsplit("/", 1)[1] for p in loaders.listed(spark, [f"{root}/f", f"{root}/f/*.json"])] == ["a.jsonl", "b.json"]
    both = loaders.concatenated(spark, [f"{root}/scores", f"{root}/scores"], 2, "x")
    assert both.count() == 2
    for k in (1, 10, 9):
        (tmp_path / "ckpt" / f"global_step_{k}").mkdir(parents=True)
    assert loaders.latest_folder(spark, f"{root}/ckpt").endswith("global_step_10") and [p.rsplit("_", 1)[1] for p in loaders.outdated_folders(spark, f"{root}/ckpt", 2)] == ["1"]
    (tmp_path / "ckpt" / "latest_checkpointed_iteration.txt").write_text("9\n")
    assert loaders.latest_folder(spark, f"{root}/ckpt").endswith("global_step_9")
    made = []
    for _ in range(2):
        table = loaders.memo(spark, f"{root}/memo", 1, ("cfg", "rl"), lambda: made.append(1) or spark.range(3))
    assert table.count() == 3 and made == [1]
    target = loaders.staged(spark, f"{root}/f/c.txt", f"{root}/stage")
    assert target.endswith("/c.txt") and loaders.exists(spark, target)
    with pytest.raises(ValueError):
        loaders.by_suffix(spark, "x.bin", "a int")
    assert loaders.first_of(spark, [f"{root}/none", f"{root}/scores"]).count() == 3


def test_nested_columns(spark):
    df = spark.createDataFrame([(({"b": "x"}, 1), ["only"])], "a struct<m: map<string,string>, n: int>, l array<string>")
    r = df.select(loaders.nested(df, "a.m.b").alias("x"), loaders.nested(df, "a.m.q", "d").alias("y"), loaders.nested(df, "z.q", "d").alias("z"), loaders.unwrapped(df, "l").alias("u")).first()
    assert tuple(r) == ("x", "d", "d", "only")
    rows = loaders.with_responses(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "k int, o int, t string"), "k", "o", "t").orderBy("k").collect()
    assert [r["responses"] for r in rows] == [["a", "b"], []]


def test_search_retries(spark):
    import urllib.error

    calls, waits = [], []

    def send(body):
        calls.append(json.loads(body))
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return json.dumps({"result": [[{"document": {"contents": "t\nbody"}}]]}).encode()

    assert loaders.search(["q"], "u", send=send, sleep=waits.append)[0][0]["document"]["contents"] == "t\nbody" and waits == [1.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        loaders.search(["q"], "u", send=lambda b: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", {}, None)), sleep=waits.append)
    answer = lambda body: json.dumps({"result": [[{"document": {"contents": "doc of " + q}}] for q in json.loads(body)["queries"]]}).encode()
    got = loaders.searched(spark.createDataFrame([(1, "a"), (2, "b")], "k int, q string"), "k", "q", "u", send=answer).orderBy("k").collect()
    assert [r["documents"] for r in got] == [["doc of a"], ["doc of b"]]


# names


def test_named(spark, tmp_path):
    assert {"naive", "batch", "formatted"} <= set(named.REWARDS)
    score = spark.range(1).select(named.REWARDS["naive"](F.lit("x </T> Pe2e4"), F.array(F.lit("e2e4"))).alias("a"), G.safe(F.lit(float("nan"))).alias("b")).first()
    assert tuple(score) == (1.0, 0.0)
    tokens = named.TOKENIZERS["moves"]()
    text = one(spark, tokens.decode(tokens.encode(F.lit("Pe2e4 Pe7e5"))))[0]
    assert text == "Pe2e4 Pe7e5" and tokens.id_of("<bos>") is not None
    with pytest.raises(KeyError):
        named.TOKENIZERS["none"]

    class Simple(named.Evaluator):
        def load(self, spark, path):
            return spark.read.parquet(path)

    path = str(tmp_path / "t")
    spark.createDataFrame([("s", "Nf3", "nf3+", True, 1), ("s", "Nf3", None, False, 2), (None, "x", "x", True, 3)], "state string, target string, predicted string, legal boolean, k int").write.parquet(path)
    r = Simple().evaluate(spark, path, "k").first()
    assert (r["legal_accuracy"], r["match_accuracy"], r["num_total"]) == (0.5, 0.5, 2)


def test_distribution_helpers(spark):
    p = F.array(*[F.lit(x) for x in (0.1, 0.5, 0.4)])
    assert one(spark, D.top_mass(p, 2), D.clamped(F.lit(3.0), 0.0, 1.0)) == (pytest.approx(0.9), 1.0)


def test_small_helpers(spark, tmp_path):
    from rillstone.operators import advantages as A
    from rillstone.sources import files

    assert A.next_kl_weight(0.1, 6.0, 3.0, 100, 1000.0) == pytest.approx(0.1 * (1 + 0.2 * 0.1)) and A.LOSSES["vanilla"] is A.clipped_objective
    rows = spark.createDataFrame([(0, 2), (1, 3)], "row long, times int")
    assert B.repeat(rows, F.col("times")).groupBy("row").count().orderBy("row").collect()[1]["count"] == 3
    df = spark.createDataFrame([("a", [1, 2])], "shard string, ids array<int>")
    files.token_table(df, "ids", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["ids"] == [1, 2]
    got = spark.createDataFrame([("1. e4 e5 <T> x",), ("1. e9 <T>",)], "t string").select(notation.final_position("t").alias("p")).collect()
    assert got[0]["p"] == rules.replay(["e4", "e5"])[1][-1].fen() and got[1]["p"] is None
    assert [len(p) for p in B.checked_partitions([3, 3, 2, 2], 2)] == [2, 2]
    with pytest.raises(ValueError):
        B.checked_partitions([1], 2)


def test_turns_by_boundary(spark):
    rows = [(["Pd2", "d4", " ", "Ng1", "f3 x", " Pe2e4"], ["Pd7d5", "Ng8f6"]), (["no", " move"], ["a"]), (["Pd2d4", "<eos>", "Pe2e4"], ["a", "b"]), (None, None)]
    df = spark.createDataFrame(rows, "t array<string>, r array<string>")
    got = [[tuple(x) for x in r["x"]] for r in df.select(S.boundary_turns()("t", "r").alias("x")).collect()]
    assert got == [[("Pd2d4", 2, "Pd7d5"), ("Ng1f3", 5, "Ng8f6"), ("Pe2e4", 6, None)], [], [("Pd2d4", 1, "a")], []]


def test_padded_chunks_and_batches(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "row long")
    got = B.padded_chunks(df, 5, 3).orderBy("row").collect()
    assert [(r["row"], r["chunk"]) for r in got] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    tokens = named.TOKENIZERS["moves"]()
    r = one(spark, tokens.batch(F.lit("Pe2e4"), 8), tokens.batch(F.lit("Pe2e4 Pe7e5"), 4, left=True, cut="left"))
    assert r[0]["attention_mask"] == [1, 1, 1, 1, 1, 0, 0, 0] and len(r[1]["input_ids"]) == 4 and r[1]["attention_mask"] == [1, 1, 1, 1]


def test_cuts_hold_where_lowering_grows_a_text():
    mark = N.BEFORE[0]
    plain = N._cut(f"so {mark.upper()} 42 apples")
    assert plain[0] and N._cut(f"{chr(0x130) * 9} so {mark.upper()} 42 apples") == plain


def sql_equals(spark, folder, name, tables):
    """The query over tables of these rows against its SQL, by text, so that -0.0 isn't 0.0."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ours = entry.queries()[name](spark, str(folder))
    theirs = con.sql(entry.oracle_sql()[name])
    columns = [theirs.columns.index(c) for c in ours.columns]
    a, b = sorted(map(repr, map(tuple, ours.collect()))), sorted(repr(tuple(r[k] for k in columns)) for r in theirs.fetchall())
    assert a == b


def test_centred_logs_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    rows = [(1, [0.5, 0.50001]), (2, [0.49999, 3.0]), (3, [1.0, 1.0]), (4, []), (5, None), (6, [None, 2.0])]
    sql_equals(spark, tmp_path, "centred_logs", {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>")})


def test_one_per_key_orders_by_the_weighted_sum(spark, tmp_path):
    rows = [(1, 30_000, 10.0), (1, 5, 10.01), (2, 7, 20.0), (2, 6, 20.0), (3, None, 1.0), (3, 4, 2.0), (4, 9, None), (4, 8, 3.0), (5, 1, None), (None, 2, 4.0)]
    sql_equals(spark, tmp_path, "one_per_key", {"lineitem": spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_extendedprice double")})


def test_boxes_are_counted_by_brace_and_evaluated_once(spark, tmp_path):
    c = F.col("t")
    texts = ["\\boxed{a{b}c}", "\\boxed{\U0001d465{\U0001d466}} z", "\\boxed{}", "\\boxed{{}", "no", None, "\\boxed{1} \\boxed{2", "\\boxed{1} \\boxed{{2}{}}}}", "\\boxed{line\nbreak}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["a{b}c", "\U0001d465{\U0001d466}", "", None, None, None, None, "{2}{}", "line\nbreak"]
    assert [r["b"] for r in df.select(N.boxed(c).alias("b")).collect()] == want
    # the text of a row is read once a check, however many comparisons follow
    plan = df.select(N.after_thought_right(F.upper(c), F.array(F.lit("1"), F.lit("2"))).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
    rows = [(k, "Brand {name}" if k % 3 else None, k % 9) for k in range(300)]
    tables = {"part": spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int")}
    sql_equals(spark, tmp_path, "answers_after_thought", tables)
    from rillstone.plans import answer_queries

    for query in (answer_queries.boxed, answer_queries.after_thought):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() >= 32


def test_words_of_moves_against_plain_patterns(spark):
    import re

    rng = random.Random(4)
    words = ["".join(rng.choice(["P", "N", "K", "a1", "e4", "h8", "x", "=", "=Q", "R", "+", "#", "O-O", "O-O-O", "z", "-"]) for _ in range(rng.randrange(1, 7))) for _ in range(600)]
    words += ["Pe7xd8=N#", "Pe2e4+", "O-O+", "O-O-O#+", "Pe7d8Q+", "Pe2e4\n", "Pe2e4+\n\n", "Pe2e4\x0c"]
    c = F.col("w")
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", M.to_uci(c).alias("uci"), L.word_tokens(c).alias("tokens"))
    for w, uci, tokens in df.collect():
        move = re.search(r"^[PNBRQK]([a-h][1-8])x?([a-h][1-8])(?:=([QRBN]))?[+#]*$", w)
        bare = re.sub(r"[+#]+$", "", w)
        assert uci == ({"O-O": "e1g1", "O-O-O": "e1c1"}.get(bare) or (move and "".join(g or "" for g in move.groups()).replace("Q", "q").replace("R", "r").replace("B", "b").replace("N", "n"))) or (uci is None and move is None), w
        if bare in ("O-O", "O-O-O"):
            want = [bare, w[len(bare) :]]
        elif w[0] in "KQRBNP":
            g = list(re.match(r"^([KQRBNP])([a-h][1-8])?(x)?([a-h][1-8])?(=)?([QRBN])?([+#])?", w).groups())
            want = [*g[:5], g[5] if g[4] else "", g[6]]
        else:
            want = [w]
        assert tokens == [t for t in want if t], w
    # one look-up a word, among a few; one pattern a move
    plan = df.select("tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") <= 2
    vocab = L.vocabulary()
    ids = spark.range(1).select(L.ids_of(F.array(*[F.lit(w) for w in vocab]), vocab).alias("i")).first()["i"]
    assert ids == [0, *vocab.values(), 1]
