"""Moves in text, their grades and evaluation tables on the driver's tables: words are built from lines of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import moves as M
from ..operators import grading as G
from ..sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


WORD = """CASE WHEN l_partkey % 50 = 0 THEN 'O-O' WHEN l_partkey % 50 = 1 THEN 'O-O-O+' ELSE concat(substr('PNBRQKZ', CAST(l_partkey % 7 + 1 AS INT), 1), substr('abcdefgh', CAST(l_suppkey % 8 + 1 AS INT), 1), CAST(l_partkey % 8 + 1 AS VARCHAR(9)),
CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE '' END, substr('abcdefgh', CAST(l_partkey % 8 + 1 AS INT), 1), CAST(l_suppkey % 8 + 1 AS VARCHAR(9)), CASE WHEN l_suppkey % 5 = 0 THEN '=Q' ELSE '' END, CASE WHEN l_partkey % 4 = 0 THEN '+' ELSE '' END) END"""
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
WORDS = f"w AS (SELECT {KEYS}, l_returnflag, {WORD} AS w FROM lineitem)"
IS_MOVE = "regexp_matches({c}, '^(O-O-O|O-O|[PNBRQK][a-h][1-8]x?[a-h][1-8](=[QRBN])?)[+#]*$')"
UCI = "CASE WHEN regexp_replace({c}, '[+#]+$', '') = 'O-O' THEN 'e1g1' WHEN regexp_replace({c}, '[+#]+$', '') = 'O-O-O' THEN 'e1c1' WHEN " + IS_MOVE + " THEN regexp_extract({c}, '^.([a-h][1-8])x?([a-h][1-8])', 1) || regexp_extract({c}, '^.([a-h][1-8])x?([a-h][1-8])', 2) || lower(regexp_extract({c}, '=([QRBN])', 1)) END"


def words(s, d):
    return table(s, d, "lineitem").select(*KEYS.split(", "), "l_returnflag", F.expr(WORD).alias("w"))


@query("move_words", f"WITH {WORDS}, b AS (SELECT *, replace(regexp_replace(w, '[+#]', '', 'g'), 'x', '') AS plain FROM w) SELECT {KEYS}, {IS_MOVE.format(c='w')} AS is_move, {UCI.format(c='w')} AS uci, CASE WHEN plain = 'O-O' THEN 'castle_kingside' WHEN plain = 'O-O-O' THEN 'castle_queenside' ELSE (CASE WHEN length(split_part(plain, '=', 1)) >= 5 AND plain[1] <> 'Z' THEN split_part(plain, '=', 1)[2:] ELSE split_part(plain, '=', 1) END) || lower(split_part(plain, '=', 2)) END AS coordinates, lower(regexp_replace(w, '[+#]+$', '')) AS normal FROM b")
def move_words(s, d):
    w = F.col("w")
    return words(s, d).select(*KEYS.split(", "), M.is_move(w).alias("is_move"), M.to_uci(w).alias("uci"), M.coordinates(w).alias("coordinates"), M.normal_move(w).alias("normal"))


# an order as an output: the thought ends after the second line, every third line ends in a call
PART = "w || CASE WHEN l_linenumber = 2 THEN ' </T>' ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN ' <call_env>' ELSE '' END"
TEXTS = f"{WORDS}, o AS (SELECT l_orderkey, '<T> ' || string_agg({PART}, ' ' ORDER BY {KEYS}) AS t, list({UCI.format(c='w')} ORDER BY {KEYS}) AS u FROM w GROUP BY 1)"
MOVES = "list_filter(string_split({c}, ' '), lambda x: " + IS_MOVE.format(c="x") + ")"
TAIL = "CASE WHEN len(string_split(t, '</T>')) - 1 {n} THEN substr(t, strpos(t, '</T>') + 4) END"


def texts(s, d):
    part = F.concat("w", F.when(F.col("l_linenumber") == 2, " </T>").otherwise(""), F.when(F.col("l_linenumber") % 3 == 0, " <call_env>").otherwise(""))
    rows = words(s, d).select(*KEYS.split(", "), part.alias("part"), M.to_uci(F.col("w")).alias("uci"))
    seq = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "part", "uci"))).alias("q"))
    return seq.select("l_orderkey", F.concat(F.lit("<T> "), F.array_join("q.part", " ")).alias("t"), F.col("q.uci").alias("u"))


@query("turn_moves", f"""WITH {TEXTS}, f AS (SELECT *, {TAIL.format(n='= 1')} AS tail FROM o) SELECT l_orderkey, ({MOVES.format(c='t')})[1] AS first_move, ({MOVES.format(c='t')})[-1] AS last_move, ({MOVES.format(c='tail')})[1] AS after, len(string_split(t, '</T>')) = 2 AS formatted FROM f""")
def turn_moves(s, d):
    t = F.col("t")
    after = M.move_after_thought(t)
    return texts(s, d).select("l_orderkey", M.first_move(t).alias("first_move"), M.last_move(t).alias("last_move"), after["move"].alias("after"), after["formatted"].alias("formatted"))


SEGMENT = f"coalesce(({MOVES.format(c='CASE WHEN contains(x, chr(60) || chr(47) || chr(84) || chr(62)) THEN substr(x, strpos(x, chr(60) || chr(47) || chr(84) || chr(62)) + 4) END').replace('lambda x:', 'lambda y:').replace('regexp_matches(x,', 'regexp_matches(y,')})[1], ({MOVES.format(c='x').replace('lambda x:', 'lambda y:').replace('regexp_matches(x,', 'regexp_matches(y,')})[-1])"
OWN = f"list_transform(string_split(t, '<call_env>')[:-2], lambda x: {SEGMENT})"


@query("own_moves", f"WITH {TEXTS} SELECT l_orderkey, {OWN} AS moves FROM o")
def own(s, d):
    return texts(s, d).select("l_orderkey", M.own_moves(F.col("t")).alias("moves"))


@query("one_turn_grades", f"""WITH {TEXTS}, f AS (SELECT *, {TAIL.format(n='= 1')} AS tail, {MOVES.format(c='t')} AS m FROM o), g AS (SELECT l_orderkey, u, CASE WHEN tail IS NOT NULL THEN ({MOVES.format(c='tail')})[1] ELSE m[1] END AS move, tail IS NOT NULL AS formatted FROM f), h AS (SELECT *, {UCI.format(c='move')} AS uci FROM g)
SELECT l_orderkey, coalesce(CAST(uci = u[2] AS DOUBLE), 0) AS score, coalesce(move, '') AS extracted_move, coalesce(uci, '') AS extracted_uci, CAST(formatted AS DOUBLE) AS format_score, CASE WHEN formatted THEN coalesce(CAST(uci = u[2] AS DOUBLE), 0) ELSE 0 END AS formatted_score FROM h""")
def graded(s, d):
    targets = F.array(F.get("u", F.lit(1)))
    r, f = G.one_turn(F.col("t"), targets), G.one_turn(F.col("t"), targets, "formatted")
    return texts(s, d).select("l_orderkey", r.alias("r"), f["score"].alias("formatted_score")).select("l_orderkey", "r.score", "r.extracted_move", "r.extracted_uci", "r.format_score", "formatted_score")


@query("several_turns_grades", f"""WITH {TEXTS}, f AS (SELECT l_orderkey, list_transform({OWN}, lambda z: CASE WHEN z IS NULL THEN '' ELSE coalesce({UCI.format(c='z')}, z) END) AS found, u[3:3] AS wanted FROM o) SELECT l_orderkey, found AS extracted, CASE WHEN len(found) > 0 AND found = wanted AND NOT list_contains(found, '') THEN 1::DOUBLE ELSE 0::DOUBLE END AS score FROM f""")
def several(s, d):
    r = G.several_turns(F.col("t"), F.slice("u", F.lit(3), F.lit(1)))
    return texts(s, d).select("l_orderkey", r.alias("r")).select("l_orderkey", "r.extracted", "r.score")


NORM = "lower(regexp_replace({c}, '[+#]+$', ''))"
PAIRED = f"{WORDS}, p AS (SELECT l_returnflag, w AS predicted, {WORD.replace('l_partkey % 4 = 0', 'l_partkey % 5 = 0').replace('l_partkey % 3 = 0', 'l_partkey % 6 = 0')} AS target, l_partkey % 3 <> 1 AS legal, l_suppkey % 2 = 0 AS formatted FROM (SELECT *, {WORD} AS w FROM lineitem))"


def paired(s, d):
    target = F.expr(WORD.replace("l_partkey % 4 = 0", "l_partkey % 5 = 0").replace("l_partkey % 3 = 0", "l_partkey % 6 = 0"))
    return table(s, d, "lineitem").select("l_returnflag", F.expr(WORD).alias("predicted"), target.alias("target"), (F.col("l_partkey") % 3 != 1).alias("legal"), (F.col("l_suppkey") % 2 == 0).alias("formatted"))


@query("prediction_metrics", f"WITH {PAIRED}, h AS (SELECT *, {NORM.format(c='predicted')} = {NORM.format(c='target')} AS hit FROM p) SELECT l_returnflag, round(avg(legal::INT), 6) AS legal_accuracy, count(*) FILTER (legal) AS num_legal, round(avg(hit::INT), 6) AS match_accuracy, count(*) FILTER (hit) AS num_matches, count(*) AS num_total, round(avg(formatted::INT), 6) AS format_rate, round(avg(hit::INT) FILTER (formatted), 6) AS match_when_formatted FROM h GROUP BY 1")
def metrics(s, d):
    r = G.evaluation(paired(s, d), "predicted", "target", "legal", "formatted", ["l_returnflag"])
    return r.select(*[F.round(c, 6).alias(c) if c.endswith(("accuracy", "rate", "formatted")) else F.col(c) for c in r.columns])


@query("match_accuracy", f"WITH {PAIRED} SELECT l_returnflag, round(avg(({NORM.format(c='predicted')} = {NORM.format(c='target')})::INT), 6) AS match_accuracy, count(*) FILTER ({NORM.format(c='predicted')} = {NORM.format(c='target')}) AS num_matches, count(*) AS num_total FROM p GROUP BY 1")
def matched(s, d):
    return G.match_accuracy(paired(s, d), "predicted", "target", by=["l_returnflag"]).withColumn("match_accuracy", F.round("match_accuracy", 6))


@query("legal_accuracy", f"WITH {PAIRED} SELECT l_returnflag, round(avg(legal::INT), 6) AS legal_accuracy, count(*) FILTER (legal) AS num_legal, count(*) AS num_total FROM p GROUP BY 1")
def legal(s, d):
    return G.legal_accuracy(paired(s, d), "legal", ["l_returnflag"]).withColumn("legal_accuracy", F.round("legal_accuracy", 6))


@query("any_of_k_matches", f"WITH {WORDS}, o AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE w END) AS p, max(w) AS t FROM w GROUP BY 1), h AS (SELECT len(p) AS k, len(list_filter(p, lambda x: x IS NOT NULL AND {NORM.format(c='x')} = {NORM.format(c='t')})) > 0 AS hit FROM o) SELECT CAST(k AS INT) AS k, round(avg(hit::INT), 6) AS pass_at_k, count(*) FILTER (hit) AS num_passed, count(*) AS num_total FROM h GROUP BY 1")
def any_of(s, d):
    rows = words(s, d).select("l_orderkey", F.struct(F.when(F.col("l_partkey") % 9 != 0, F.col("w")).alias("p")).alias("x"), "w")
    rows = rows.groupBy("l_orderkey").agg(F.transform(F.collect_list("x"), lambda x: x["p"]).alias("p"), F.max("w").alias("t")).withColumn("k", F.size("p"))
    return G.any_match(rows, "p", "t", by=["k"]).withColumn("pass_at_k", F.round("pass_at_k", 6))


@query("centipawn_gap", "WITH b AS (SELECT p_partkey, CAST(p_retailprice - 1000 AS BIGINT) AS cp FROM part), g AS (SELECT greatest(0, a.cp + b.cp)::DOUBLE AS g FROM b a JOIN b ON b.p_partkey = a.p_partkey + 1) SELECT round(avg(g), 5) AS cp_gap_mean, round(quantile_cont(g, 0.5), 5) AS cp_gap_median, count(*) AS num_evaluated FROM g")
def gap(s, d):
    scores = table(s, d, "part").select("p_partkey", F.round(F.col("p_retailprice") - 1000).cast("long").alias("cp"))
    played = scores.select("p_partkey", F.lit("m").alias("move"), (F.col("p_partkey") + 1).alias("child"))
    r = G.centipawn_gap(played, scores, "p_partkey", "move", "child", "cp")
    return r.select(F.round("cp_gap_mean", 5).alias("cp_gap_mean"), F.round("cp_gap_median", 5).alias("cp_gap_median"), "num_evaluated")


@query("score_by_source", "WITH r AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'R' THEN 1::DOUBLE ELSE 0 END) AS m FROM lineitem GROUP BY 1) SELECT o_orderpriority, round(avg(m), 6) AS score, count(*) AS n FROM orders JOIN r ON l_orderkey = o_orderkey GROUP BY 1")
def by_source(s, d):
    r = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_returnflag").alias("responses"))
    rows = table(s, d, "orders").select("o_orderkey", "o_orderpriority").join(r, "o_orderkey")
    return G.mean_by_source(rows, "o_orderpriority", "responses", lambda x: x == "R").withColumn("score", F.round("score", 6))


@query("metric_sections", "WITH m AS (SELECT event_type, CASE WHEN event_type < 'd' THEN 'acc' ELSE event_type END AS variable, CASE user_id % 4 WHEN 0 THEN 'mean@' WHEN 1 THEN 'std@' WHEN 2 THEN 'maj@' ELSE 'best@' END || (user_id % 3) AS metric, user_id % 3 AS n, user_id FROM events) SELECT DISTINCT variable, metric, n, CASE WHEN variable = 'acc' AND regexp_matches(metric, '^(mean|maj|best)@') AND n = max(n) OVER (PARTITION BY variable) THEN 'val-core' ELSE 'val-aux' END AS section FROM m")
def sections(s, d):
    k = F.col("user_id")
    name = F.when(k % 4 == 0, "mean@").when(k % 4 == 1, "std@").when(k % 4 == 2, "maj@").otherwise("best@")
    rows = table(s, d, "events").select(F.when(F.col("event_type") < "d", "acc").otherwise(F.col("event_type")).alias("variable"), F.concat(name, (k % 3).cast("string")).alias("metric"), (k % 3).alias("n")).distinct()
    return G.metric_names(rows, "variable", "metric", "n").select("variable", "metric", "n", "section")


@query("constant_group_means", "WITH g AS (SELECT l_orderkey, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1) SELECT round(avg(a), 6) AS l_discount, round(avg(b), 6) AS l_tax FROM g")
def constant(s, d):
    r = G.constant_per_group(table(s, d, "lineitem").withColumn("label", F.col("l_orderkey") % 7), "l_orderkey", "label", ["l_discount", "l_tax"])
    return r.select(F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


@query("evaluation_table", f"WITH {PAIRED}, h AS (SELECT *, {NORM.format(c='predicted')} = {NORM.format(c='target')} AS hit FROM p), x AS (SELECT l_returnflag, avg(hit::INT) AS a, count(*) FILTER (hit) AS b, count(*) AS c FROM h GROUP BY 1) SELECT l_returnflag || '/match_accuracy' AS metric, round(a, 6) AS value FROM x UNION ALL SELECT l_returnflag || '/num_matches', b FROM x UNION ALL SELECT l_returnflag || '/num_total', c FROM x")
def evaluations(s, d):
    rows = paired(s, d)
    grade = lambda df: G.match_accuracy(df, "predicted", "target")
    r = G.evaluations(s, [(flag, rows.filter(F.col("l_returnflag") == flag), grade, None) for flag in ("A", "N", "R")], "predicted")
    return r.withColumn("value", F.round("value", 6))
