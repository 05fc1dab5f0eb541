"""The engine's own operators: every query against its SQL, and what SQL can't express against brute force."""

import itertools
import math
import random

import pytest

from rillstone import bindings
from rillstone.functions import distributions as D
from rillstone.functions import final_answers as N
from rillstone.functions import lan_tokens as L
from rillstone.functions import notation, rollout_text, rules
from rillstone.functions import text as X
from rillstone.operators import advantages as A
from rillstone.operators import batch as B
from rillstone.operators import evaluation as E
from rillstone.operators import rewards as R
from rillstone.operators import states as S
from rillstone.operators import tokens as K
from rillstone.operators import traversals as V
from rillstone.operators import trees as T
from rillstone.plans.registry import Registry, load_function
from rillstone.sources import files
from rillstone.streaming import metrics as M

F = pytest.importorskip("pyspark.sql.functions")
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations sale_lines items".split()


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", bindings.queries())
def test_query(name, spark, duck):
    df = bindings.queries()[name](spark, SMALL)
    rows, sql = df.collect(), bindings.oracle_sql().get(name)
    assert rows
    if sql:
        found = duck.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(found.columns)
        at = [found.columns.index(c) for c in cols]
        assert sorted([tuple(plain(r[c]) for c in cols) for r in rows], key=repr) == sorted([tuple(plain(r[k]) for k in at) for r in found.fetchall()], key=repr)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_pass_at_k_edges(spark):
    r = one(spark, E.pass_at_k(F.lit(4), F.lit(0), 8), E.pass_at_k(F.lit(4), F.lit(0), 2), E.pass_at_k(F.lit(10), F.lit(3), 5))
    assert r[0] == 1.0 and r[1] == 0.0 and r[2] == pytest.approx(1 - math.comb(7, 5) / math.comb(10, 5))


def test_best_of_n_is_the_expectation(spark):
    vals = [3.0, 1.0, 2.0, 2.0]
    row = spark.createDataFrame([(vals,)], "vals array<double>").select(E.best_of_n(True, 3), E.best_of_n(False, 3)).first()
    draws = list(itertools.product(vals, repeat=3))
    assert row[0] == pytest.approx(sum(map(max, draws)) / len(draws)) and row[1] == pytest.approx(sum(map(min, draws)) / len(draws))


def test_stepwise_example(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 0.0), ("g", 1, 1.0)], "g string, k int, r double")
    assert sorted(round(r["advantage"], 3) for r in A.stepwise(df, "g", "k", "r", eps=0).collect()) == [-1.155, 0.577, 0.577]


def test_divergences(spark):
    p, q = [0.2, 0.3, 0.5], [0.5, 0.25, 0.25]
    a, b = (F.array(*map(F.lit, v)) for v in (p, q))
    r = one(spark, D.kl(a, b), D.entropy(a), D.jsd(a, b), D.power(a, 2.0), D.softmax(F.array(F.lit(0.0), F.lit(math.log(3.0)))))
    kl = lambda x, y: sum(u * math.log(u / v) for u, v in zip(x, y, strict=True))
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    assert r[0] == pytest.approx(kl(p, q)) and r[1] == pytest.approx(-sum(x * math.log(x) for x in p)) and r[2] == pytest.approx((kl(p, m) + kl(q, m)) / 2)
    assert r[3] == pytest.approx([x * x / 0.38 for x in p]) and r[4] == pytest.approx([0.25, 0.75])


def test_alpha_is_found(spark):
    rows = []
    for s in range(3):
        p = [random.Random(s * 10 + k).random() for k in range(5)]
        p = [x / sum(p) for x in p]
        q = [x**1.7 for x in p]
        rows += [(s, k, x, y / sum(q)) for k, (x, y) in enumerate(zip(p, q, strict=True))]
    df = spark.createDataFrame(rows, "s int, a int, p double, q double")
    assert S.best_alpha(df, "s", "a") == pytest.approx(1.7, abs=1e-2)


def test_text_functions(spark):
    c = F.lit
    r = one(
        spark, X.reasoning(c("a </T> b")), X.reasoning(c("x <T> y")), N.boxed(c(r"\boxed{1} \boxed{\frac{1}{2}}")), X.strict_number(c("#### 1,234")), X.flexible_number(c("so 3 then 45.")),
        X.lan_to_uci(c("Pe7e8=Q")), X.lan_to_uci(c("O-O"), False), X.split_lan(c("Nd4xe6+")), X.decode_list(c("['a', 'b']")), X.decode_list(c("a, b c")), X.normal_answer(c("The  Cat, a dog!")),
        X.numbers_equal(c("50"), c("0.5")), X.cp_label(c(300)), X.cp_label(c(301)), X.cp_label(c(-50)), X.strip_env_pairs(c("A <call_env> B C")), X.position_key(c("x w KQ - 0 1")), X.model_size_millions(c("run_50m x")),
    )
    assert list(r) == [
        "a ", " y", r"\frac{1}{2}", "1234", "45", "e7e8q", "e8g8", ["N", "d4", "x", "e6", "+"], ["a", "b"], ["a", "b", "c"], "cat dog", True, "+2", "+3", "-0.5", "A C", "x w", None if r[17] is None else 50,
    ]


def test_lines_of_a_trace(spark):
    line = "<T> Pe2e4 Pe7e5 Ng1f3 <sep> Pe2e4 Pc7c5 <sep> Pd2d4 </T>"
    df = spark.createDataFrame([(1, line)], "tree int, text string").select("tree", F.posexplode(X.lines_of(F.col("text"))).alias("line", "moves"))
    r = T.shape(T.visits(df, "tree", "line", "moves"), "tree").first()
    assert (r["root_candidates"], r["nodes"], r["leaves"], r["max_depth"], r["visits"]) == (2, 5, 3, 3, 6)
    assert T.dfs_consistency(T.visits(df, "tree", "line", "moves"), "tree", "line").first()["tau"] == 1.0
    assert T.linearise(T.visits(df, "tree", "line", "moves"), "tree", "line").first()["text"] == line


def test_minimax(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (1, "b", 1, None), (1, "a x", 2, 3.0), (1, "a y", 2, 1.0), (1, "b x", 2, 2.0), (1, "b y", 2, 5.0)], "tree int, prefix string, depth int, value double")
    assert T.minimax(df, "tree", 2).first()["value"] == 2.0


def test_rewards(spark):
    c = F.lit
    moves = lambda *m: F.array(*map(c, m))
    r = one(
        spark, R.single_turn(c("<T> x </T> Pe2e4"), c("e2e4")), R.single_turn(c("Pe2e4"), c("e2e4")), R.multi_turn(moves("Pe2e4", "zz"), moves("e2e4", "zz")), R.multi_turn(moves("Pe2e4"), moves("e2e4", "x")),
        R.exact_answer(c("<answer>The Cat</answer>"), moves("cat")), R.overlong_penalty(c(110), 120, 20, 1.0), R.number_answer(c("#### 7"), c("7")),
    )
    assert list(r) == [1.0, 0.0, 1.0, 0.0, 1.0, -0.5, 1.0]
    df = spark.createDataFrame([(2.0, [1, 1, 0])], "s double, m array<int>")
    assert R.place_on_last_token(df, "s", "m").first()["token_rewards"] == [0.0, 2.0, 0.0]
    with pytest.raises(Exception, match="no reward"):
        spark.range(1).select(R.route(c("zz"), {"a": c(1.0)})).collect()


def test_masks(spark):
    ids = F.array(*map(F.lit, [23, 98, 1, 0, 0]))
    r = one(spark, K.eos_mask(ids, 1), K.strip_pads(ids), K.positions(F.array(*map(F.lit, [0, 0, 1, 1, 1]))))
    assert list(r) == [[1, 1, 1, 0, 0], [23, 98, 1], [0, 0, 0, 1, 2]]


def test_balancing():
    rng = random.Random(1)
    for equal in (False, True):
        sizes = [rng.randrange(1, 500) for _ in range(64)]
        parts = B.largest_differencing(sizes, 8, equal)
        assert sorted(i for p in parts for i in p) == list(range(64)) and (not equal or all(len(p) == 8 for p in parts))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) < 0.05 * sum(sums) / 8
    assert B.greedy_least_loaded([5, 1, 1, 1], 2) == [0, 1, 1, 1] and B.micro_batches(1001, 250, multiple=2) == 6


def test_batch_union_conflict(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3)], "k int, x int")
    with pytest.raises(Exception, match="differs"):
        B.positional_union(a, b, "k").collect()


def test_resampling_follows_weights(spark):
    df = spark.range(1, 101)
    rows = B.systematic_resample(df, "id", F.col("id").cast("double"), 5050, 3).collect()
    n = {}
    for r in rows:
        n[r["id"]] = n.get(r["id"], 0) + 1
    assert all(abs(n[k] - k) <= 1 for k in range(1, 101))


def test_registry(tmp_path):
    r = Registry("thing")
    f = r.register("a", len)
    assert r.register("a", len) is f and r["a"] is len and "b" not in r
    with pytest.raises(ValueError, match="taken"):
        r.register("a", max)
    with pytest.raises(KeyError, match="unknown"):
        r["b"]
    (tmp_path / "own.py").write_text("def score(x, k=1):\n    return x * k\n")
    assert load_function(str(tmp_path / "own.py"), "score", k=3)(2) == 6


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi"\nthere', 5), ("2", None, 7)], "id string, FEN string, n int")
    files.write_csv(df, str(tmp_path / "t.csv"), ["FEN", "id", "missing"])
    back = files.csv_table(spark, str(tmp_path / "t.csv"), "FEN string, id string")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([('say "hi"\nthere', "1"), (None, "2")], key=repr)
    files.write_parquet(df, str(tmp_path / "p" / "x=1" / "t.parquet"))
    assert files.parquet_tree(spark, str(tmp_path / "p")).columns == ["id", "FEN", "n"]
    assert [r["FEN"] for r in files.mixed_tables(spark, [str(tmp_path / "t.csv"), str(tmp_path / "a.txt")], "FEN string, id string", "FEN").collect()] == ['say "hi"\nthere']
    files.write_json_steps(df.withColumn("step", F.lit(3)), str(tmp_path / "j"))
    assert files.json_lines(spark, str(tmp_path / "j"), "id string, n int").count() == 2
    for s in (10, 9):
        (tmp_path / "r" / f"step_{s}").mkdir(parents=True)
        (tmp_path / "r" / f"step_{s}" / "a.jsonl").write_text("{}")
    assert [r["step"] for r in files.steps_in(spark, str(tmp_path / "r")).collect()] == [9, 10]
    (tmp_path / "d.json").write_text('{"results":[{"pgn":"1. e4","cot":{"a":{"t":"x"}}},{"pgn":"","cot":{"a":{"t":"y"}}}]}')
    assert [tuple(r) for r in files.nested_results(spark, str(tmp_path / "d.json"), "results array<struct<pgn string, cot struct<a struct<t string>>>>", "cot.a.t", "pgn").collect()] == [("1. e4", "x")]
    assert files.decode_truth("{'a': 1}") == {"a": 1} and files.decode_truth("[1]") == [1] and files.decode_truth("x y") == "x y"
    assert files.manifest("# c\nstage step\nrl 5\n") == [{"stage": "rl", "step": "5"}] and files.flat_keys({"a": {"b": 1}}) == {"a/b": 1}


def test_posting_retries():
    import urllib.error

    calls, waits = [], []

    def send(body):
        calls.append(body)
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 503, "", None, None)
        return body.encode()

    assert list(files.post_in_batches(["a", "b", "c"], "", 2, send=send, sleep=waits.append)) == [b"a,b", b"c"] and len(waits) == 1


def test_dialogue_state(spark, tmp_path):
    from rillstone.plans.stream_queries import _checkpoint

    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, "go <call_env>"), (1, 1, "go <call_env>"), (1, 2, "end"), (2, 0, "end")], "conv_id long, turn long, text string").write.parquet(str(src))
    stream = M.arriving(spark, str(src), "conv_id long, turn long, text string")
    out = M.drained(M.dialogues(stream), "dialogues", "update", _checkpoint(spark)).collect()
    assert {r["conv_id"]: (r["turns"], r["done"]) for r in out} == {1: (3, True), 2: (1, True)}


def test_rules_perft():
    kiwi = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"
    assert [rules.perft(rules.Position.parse(rules.START), d) for d in (1, 2, 3)] == [20, 400, 8902]
    assert [rules.perft(rules.Position.parse(kiwi), d) for d in (1, 2)] == [48, 2039]
    assert rules.perft(rules.Position.parse("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1"), 3) == 2812
    assert rules.perft(rules.Position.parse("r2q1rk1/pP1p2pp/Q4n2/bbp1p3/Np6/1B3NBn/pPPP1PPP/R3K2R b KQ - 0 1"), 2) == 264
    p = rules.Position.parse(kiwi)
    assert p.fen() == kiwi and all(p.from_san(p.san(m)) == m == p.from_uci(rules.uci(m)) for m in p.legal())


def test_notation(spark):
    game = "[Event \"x\"]\n\n1. e4 {best} e5 2. Nf3 (2. f4 exf4) Nc6 3. Bb5 a6 4. Bxc6 dxc6 5. O-O 1-0"
    df = spark.createDataFrame([(1, game, rules.START), (2, "1. e5", "bad")], "id int, g string, fen string")
    r = df.select("id", notation.canonical_line("g").alias("c"), notation.numbered_line("g").alias("n"), notation.long_tokens("g").alias("l"), notation.legal_moves("fen").alias("m"), notation.is_legal("fen", F.lit("e4")).alias("ok")).orderBy("id").collect()
    assert r[0]["c"] == "e4 e5 Nf3 Nc6 Bb5 a6 Bxc6 dxc6 O-O" and r[0]["n"].startswith("1. e4 e5 2. Nf3") and r[0]["l"][6:] == ["Bb5xc6", "Pd7xc6", "O-O"]
    assert len(r[0]["m"]) == 20 and r[0]["ok"] and r[1]["m"] is None and not r[1]["ok"] and r[1]["l"] is None
    games = spark.createDataFrame([(1, ["e2e4", "e7e5"]), (2, ["d2d4"]), (3, ["e2e5"])], "id int, moves array<string>")
    tests = spark.createDataFrame([("rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2",), (None,)], "FEN string")
    clean, removed = notation.decontaminate_games(games, tests, "id", "moves", "FEN")
    assert [r["id"] for r in removed.collect()] == [1] and sorted(r["id"] for r in clean.collect()) == [2, 3]


def test_sampling(spark):
    from rillstone.operators import sampling

    df = spark.range(3000).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("a")).withColumn("s", F.when(F.col("a") == 1, math.log(3.0)).otherwise(0.0))
    picked = sampling.gumbel_sample(df, "id", "a", "s").groupBy("a").count().collect()
    assert {r["a"]: r["count"] for r in picked}[1] == pytest.approx(2250, abs=120)
    v = F.array(*map(F.lit, [1.0, 2.0, 4.0]))
    mean, sd = spark.range(1).select(*sampling.bootstrap(v, 2, 2000, 1, F.lit("k"))).first()
    draws = [max(p) for p in itertools.product([1.0, 2.0, 4.0], repeat=2)]
    assert mean == pytest.approx(sum(draws) / 9, abs=0.08) and sd > 0
    w = spark.range(5000).select(sampling.lognormal_width(3, ["id"], 8.0, 0.3, 1, 64).alias("w")).agg(F.avg("w"), F.min("w"), F.max("w")).first()
    assert w[0] == pytest.approx(8, abs=0.3) and w[1] >= 1 and w[2] <= 64
    rows = spark.range(1000).select("id", F.col("id").cast("double").alias("c"))
    assert sampling.penalised_by_covariance(rows, "c", 0.1).agg(F.sum("penalised")).first()[0] == 100
    assert sampling.clip_by_covariance(rows, "c", 99.5, 299.5, 0.5, 1, "id").filter("keep = 0").count() == pytest.approx(100, abs=30)


def test_token_arrays(spark):
    from rillstone.functions import arrays

    a = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, arrays.masked_mean(a(1.0, 2.0, 9.0), a(1, 1, 0), 0.0), arrays.decoded(a(1, 0, 2, 3, 1), a("p", "x", "y"), 0, 3), arrays.token_of_char(a(3, 5, 9), F.lit(4)), arrays.token_of_char(a(3, 5), F.lit(9)), arrays.differences(a(1, 4, 9)))
    assert list(r) == [1.5, "x y", 1, 1, [1, 3, 5]]


def test_kendall_and_preorder():
    rng = random.Random(2)
    for _ in range(50):
        r = list(range(rng.randrange(2, 30)))
        rng.shuffle(r)
        pairs = list(itertools.combinations(range(len(r)), 2))
        assert T.kendall_tau(r) == pytest.approx(sum(1 if r[a] < r[b] else -1 for a, b in pairs) / len(pairs))
    # visited a, a x, b, a y: preorder is a, a x, a y, b
    assert T.preorder_ranks(["a", "a x", "b", "a y"]) == [0, 1, 3, 2]


def test_math_answers(spark):
    from rillstone.functions import math_answers

    pairs = [
        (r"\frac{1}{2}", "0.5", True), ("1,234", "1234", True), (r"50\%", "0.5", True), ("(1, 2)", "(1,2)", True), ("(1,2)", "[1,2]", False), ("(1,2)", "(2,1)", False), (r"x=\dfrac34", "3/4", True),
        (r"\text{Yes}.", "yes", True), ("2", "3", False), (None, "3", False), ("1/0", "1", False), (r"90^\circ", "90", True),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r["e"] for r in df.orderBy("i").select(math_answers.equal(F.col("a"), F.col("b")).alias("e")).collect()] == [w for _, _, w in pairs]


def test_segments(spark):
    from rillstone.operators import rollouts

    r = one(spark, rollouts.segment_moves(F.lit("<T> a </T> e4 x <call_env> e5 Nf3 <call_env> Nc6 tail")), rollouts.media_parts(F.lit("see <image> and <video>")))
    assert r[0] == ["e4", "Nf3"] and [tuple(x) for x in r[1]] == [("text", "see "), ("image", "<image>"), ("text", " and "), ("video", "<video>")]


def test_traversals_against_recursion(spark):
    rng = random.Random(3)
    lines = [(t, k, [rng.choice("abc") for _ in range(rng.randint(1, 4))]) for t in range(6) for k in range(8)]
    nodes = V.nodes_of(T.visits(spark.createDataFrame(lines, "tree int, line int, moves array<string>"), "tree", "line", "moves"), "tree", "line")
    nodes = nodes.withColumn("label", F.length("prefix") % 3 - 1).withColumn("value", (F.length("prefix") % 2).cast("double"))

    def children(t, prefix, valued):
        found = {}
        for tree, k, moves in lines:
            if tree == t and moves[: len(prefix)] == prefix and len(moves) > len(prefix):
                found.setdefault(moves[len(prefix)], k)
        return sorted(found, key=lambda m: (-(len(" ".join([*prefix, m])) % 2) if valued else 0, found[m]))

    def mark(t, prefix):
        n = (len(" ".join(prefix)) % 3) - 1
        return [] if children(t, prefix, False) else [f"<result>{'+' if n > 0 else ''}{n}</result>"]

    def deep(t, prefix, valued):
        out = []
        for k, m in enumerate(children(t, prefix, valued)):
            here = [*prefix, m]
            out += ["<sep>"] * (not prefix and k > 0) + ["<down>", m, *mark(t, here), *deep(t, here, valued), "<up>"]
        return out

    def broad(t, roots, layers):
        out, level = [], [[m] for m in roots]
        while level:
            out.append("<level>")
            for here in level:
                out += [here[-1], *([f"[l{len(here)}]"] if layers else []), *mark(t, here)]
            level = [[*here, m] for here in level for m in children(t, here, False)]
        return out

    options = {"label": "label"}
    for df, expected in (
        (V.traversal(nodes, "tree", directions=True, separators=True, **options), lambda t: deep(t, [], False)),
        (V.traversal(V.by_value(nodes, "tree", "value"), "tree", directions=True, separators=True, **options), lambda t: deep(t, [], True)),
        (V.traversal(nodes, "tree", breadth=True, levels=True, **options), lambda t: broad(t, children(t, [], False), False)),
        (V.traversal(nodes, "tree", breadth=True, levels=True, layers=True, separators=True, **options), lambda t: " <sep> ".join(" ".join(broad(t, [m], True)) for m in children(t, [], False)).split(" ")),
    ):
        got = {r["tree"]: r["text"] for r in df.collect()}
        assert got == {t: " ".join(expected(t)) for t in range(6)}
    with pytest.raises(ValueError):
        V.traversal(nodes, "tree", breadth=True, directions=True)


def test_traces_and_replies(spark):
    row = spark.range(1).select(
        V.trace(F.lit("a b"), F.lit("a"), F.lit("1. e4")).alias("whole"), V.trace(F.lit("a b"), F.lit("a"), F.lit("")).alias("bare"), V.trace(F.lit(""), F.lit("a")).alias("none"),
        V.interleaved(F.array(*map(F.lit, "pqrstuvw"))).alias("turns"), V.interleaved(F.array(F.lit("p"))).alias("short"),
    ).first()
    assert tuple(row) == ("1. e4 <T> a b </T> a", "<T> a b </T> a", "", "q <call_env> r s <call_env> t u <call_env>", "")


def test_notation_tokens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for move, parts in (
        ("Pe7e8=Q", "P e7 e8 = Q"), ("Nd4xe6", "N d4 x e6"), ("Ng1f3+", "N g1 f3 +"), ("O-O", "O-O"), ("O-O-O#", "O-O-O #"), ("e4", "e4"), ("Kz", "K"), ("Pe7e8Q", "P e7 e8"), ("Bx", "B x"),
    ):
        assert one(L.word_tokens(F.lit(move))) == parts.split(), move
    assert one(L.trace_tokens(F.lit("12. Pe2e4 15... 7 1-0 <T> O-O+ <sep> zz </T>"))) == "1 2 . P e2 e4 1 5 ... 7 1-0 <T> O-O + <sep> zz </T>".split()
    vocab = L.vocabulary(results=True, specials=L.SPECIALS)
    assert list(vocab)[:4] == ["<bos>", "<eos>", "<unk>", "K"] and len(vocab) == 3 + 6 + 64 + 8 + 10 + 4 + 3 and sorted(vocab.values()) == list(range(len(vocab)))  # N, ... of promotions are pieces
    text = "12. Pe2e4 Pe7e5 13... Ng1xf3+ Pa7a8=Q# O-O+ O-O-O <T> Ke1e2 <sep> Qd1d8 </T> 1-0"
    ids = L.ids_of(L.trace_tokens(F.lit(text)), vocab)
    assert one(L.text_of(ids, vocab)) == text
    assert one(L.ids_of(L.trace_tokens(F.lit("zz")), vocab)) == [0, 2, 1]
    assert one(L.text_of(F.array(F.lit(0), F.lit(9999), F.lit(1)), vocab)) == "<unk>" and one(L.ids_of(L.move_tokens(F.lit(None).cast("string")), vocab)) == [0, 1]


def test_rollout_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    vocab = L.vocabulary(results=True, specials=(*L.SPECIALS, "<call_env>"))
    ids = rollout_text.stored_ids(F.lit("Ng1f3 ?Pd4xe5! <T> O-O+ O-O-O"), vocab)
    assert one(ids) == [vocab[w] for w in "N g1 f3 P d4 x e5 <T> O-O + O-O-O".split()]
    assert one(rollout_text.shown(ids, vocab)) == "Ng1f3Pd4xe5<T>O-O+O-O-O" and one(rollout_text.shown(F.array(F.lit(999)), vocab)) == "?"
    assert one(rollout_text.turns(F.lit("a b </T> m1 <call_env> r1 m2 <call_env> m3 <call_env> tail"))).asDict() == {"thinking": "a b ", "own": ["m1", "m3"], "replies": ["r1 m2"]}
    assert one(rollout_text.turns(F.lit("m1 <call_env> x"), False)).asDict() == {"thinking": "", "own": ["m1"], "replies": []}
    assert one(rollout_text.trace_parts(F.lit("p <T> <sep> a <sep> b c <sep> <T> m"))).asDict() == {"prompt": "p", "lines": ["a", "b c"], "answer": "m"}
    assert one(rollout_text.trace_parts(F.lit("p <T> a"))).asDict() == {"prompt": None, "lines": None, "answer": "p <T> a"}
    assert one(rollout_text.response_ids(F.array(*map(F.lit, (9, 0, 5, 9, 7, 2, 8))), 2, 9)) == [5, 7, 2]
    assert [one(rollout_text.thought_and_boxed(F.lit(x))) for x in ("<think>a\n</think> so \\boxed{1}.", "<think>a \\boxed{1}", None)] == [True, False, False]
    rates = [one(rollout_text.constant_rate(F.lit(k), 4)) for k in (0, 2, 4, 9)]
    assert rates == [0.0, 0.5, 1.0, 1.0]


def test_legal_moves_in_long_notation(spark):
    fen = "r3k2r/1P6/8/8/8/8/8/R3K2R w KQkq - 0 1"
    df = spark.createDataFrame([(fen,), (rules.START,), ("junk",)], "fen string")
    found = [r["m"] for r in df.select(notation.moves_in_lan("fen").alias("m")).collect()]
    assert found[0]["e1g1"] == "O-O" and found[0]["e1c1"] == "O-O-O" and found[0]["b7a8q"] == "Pb7xa8=Q" and found[1]["g1f3"] == "Ng1f3" and len(found[1]) == 20 and found[2] is None
    words = [("O-O-O#", "e1c1"), ("O-O", "e1g1"), ("Pb7xa8=Q+", "b7a8q"), ("Pb7xa8", None), (None, None)]
    df = spark.createDataFrame([(k, fen, w) for k, (w, _) in enumerate(words)], "k int, fen string, w string").orderBy("k")
    assert [r["m"] for r in df.select("k", notation.move_of_lan("fen", "w").alias("m")).orderBy("k").collect()] == [m for _, m in words]
    got = spark.range(1).select(notation.legal_prefix(F.lit(rules.START), F.lit("1. e4 1... e5 2. Ng1f3 zz Nc6"), F.lit(9)).alias("a"), notation.legal_prefix(F.lit(rules.START), F.lit("1. e4 e5"), F.lit(1)).alias("b")).first()
    assert got["a"] == ["e2e4", "e7e5", "g1f3"] and got["b"] == ["e2e4"]
