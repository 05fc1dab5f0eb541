"""Advantages and losses on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advantages as A
from ..sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def lines(s: SparkSession, d: str) -> DataFrame:
    """Rollouts: the lines of an order, with a reward and a length."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 701).alias("reward"), F.col("l_quantity").alias("length"), (F.col("l_returnflag") == "R").cast("double").alias("hit"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_linestatus") == "O").cast("double").alias("mask"))


LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 701 AS reward, l_quantity AS length,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, l_discount AS discount, l_tax AS tax,
  CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM lineitem)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*KEYS, *[F.round(c, 6).alias(c) for c in cols])


def over_group(expr: str) -> str:
    return f"WITH {LINES}, g AS (SELECT *, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS sd, count(*) OVER w AS n, sum(reward * length) OVER w AS rl, sum(length) OVER w AS sl FROM l WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber, l_partkey, round({expr}, 6) AS advantage FROM g"


@query("grpo_advantage", over_group("(reward - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6)"))
def grpo(s, d):
    return shown(A.group_relative(lines(s, d), "l_orderkey", "reward"), "advantage")


@query("grpo_centered", over_group("reward - CASE WHEN n = 1 THEN 0 ELSE m END"))
def centred(s, d):
    return shown(A.group_relative(lines(s, d), "l_orderkey", "reward", scale=False), "advantage")


@query("rloo_advantage", over_group("CASE WHEN n = 1 THEN reward ELSE (reward - m) * n / (n - 1)::DOUBLE END"))
def rloo(s, d):
    return shown(A.leave_one_out(lines(s, d), "l_orderkey", "reward"), "advantage")


@query("opo_advantage", over_group("reward - CASE WHEN n = 1 THEN 0 ELSE rl / sl END"))
def opo(s, d):
    return shown(A.length_weighted(lines(s, d), "l_orderkey", "reward", "length"), "advantage")


@query("selfdistill_advantage", over_group("m"))
def selfdistill(s, d):
    return shown(A.outcome_over_mean(lines(s, d), "l_orderkey", "reward"), "advantage")


@query("passk_advantage", f"""WITH {LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY reward DESC, l_linenumber, l_partkey) AS p, count(*) OVER (PARTITION BY l_orderkey) AS n,
  stddev_samp(reward) OVER (PARTITION BY l_orderkey) AS sd FROM l),
s AS (SELECT l_orderkey, max(CASE WHEN p = 1 THEN reward END) AS a, max(CASE WHEN p = 2 THEN reward END) AS b FROM m GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN p = 1 THEN (a - b) / (sd + 1e-6) ELSE 0::DOUBLE END, 6) AS advantage FROM m JOIN s USING (l_orderkey) WHERE n > 1""")
def passk(s, d):
    rows = lines(s, d)
    many = rows.groupBy("l_orderkey").count().filter("count > 1").select("l_orderkey")
    rows = rows.join(many, "l_orderkey", "left_semi").withColumn("at", F.struct("l_linenumber", "l_partkey"))
    return shown(A.best_minus_second(rows, "l_orderkey", "reward", "at"), "advantage")


@query("rfpp_baseline", f"""WITH {LINES}, c AS (SELECT *, reward - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(reward) OVER w END AS x FROM l WINDOW w AS (PARTITION BY l_orderkey)),
g AS (SELECT avg(x) AS m, var_samp(x) AS v FROM c WHERE mask > 0)
SELECT l_orderkey, l_linenumber, l_partkey, round((x - m) / sqrt(v + 1e-8), 6) AS advantage FROM c, g""")
def rfpp(s, d):
    return shown(A.centred_then_whitened(lines(s, d), "l_orderkey", "reward", "mask"), "advantage")


@query("positive_advantage", f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, hit AS advantage FROM l")
def positive(s, d):
    return shown(A.positive_only(lines(s, d), "hit"), "advantage")


@query("negative_advantage", f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN hit = 1 THEN 0::DOUBLE ELSE hit - 1 END AS advantage FROM l")
def negative(s, d):
    return shown(A.negative_only(lines(s, d), "hit"), "advantage")


@query("masked_whiten", f"WITH {LINES}, g AS (SELECT avg(reward) AS m, var_samp(reward) AS v FROM l WHERE mask > 0) SELECT l_orderkey, l_linenumber, l_partkey, round((reward - m) / sqrt(v + 1e-8), 6) AS whitened FROM l, g")
def whiten(s, d):
    return shown(A.masked_whiten(lines(s, d), "reward", "mask"), "whitened")


@query("stepwise_advantage", """WITH l AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice / 701 AS reward FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS sd, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY o_custkey, l_linenumber))
SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, round((reward - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6), 6) AS advantage FROM g""")
def stepwise(s, d):
    rows = lines(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return A.stepwise(rows, "o_custkey", "l_linenumber", "reward").select("o_custkey", *KEYS, F.round("advantage", 6).alias("advantage"))


# tokens of a sequence: the lines of an order; line numbers may repeat, so the part breaks ties
TOKENS = f"{LINES}, t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, discount, tax, reward) AS pos FROM l)"


def tokens(s, d):
    from pyspark.sql.window import Window

    return lines(s, d).withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "discount", "tax", "reward")))


@query("discounted_returns", f"WITH {TOKENS} SELECT a.l_orderkey, a.pos, round(sum(sqrt(b.discount) * power(0.9::DOUBLE, b.pos - a.pos)), 6) AS returns FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND b.pos >= a.pos GROUP BY 1, 2")
def discounted(s, d):
    return A.discounted_returns(tokens(s, d).withColumn("third", F.sqrt("discount")), "l_orderkey", "pos", "third", 0.9).select("l_orderkey", "pos", F.round("returns", 6).alias("returns"))


@query("remax_returns", f"WITH {TOKENS} SELECT l_orderkey, pos, round(sum(discount) OVER (PARTITION BY l_orderkey ORDER BY pos DESC) - tax, 6) AS returns FROM t")
def remax(s, d):
    return A.discounted_returns(tokens(s, d), "l_orderkey", "pos", "discount", 1.0, baseline="tax").select("l_orderkey", "pos", F.round("returns", 6).alias("returns"))


@query("gae_returns", f"""WITH {TOKENS}, e AS (SELECT *, discount + 0.99::DOUBLE * coalesce(lead(tax) OVER (PARTITION BY l_orderkey ORDER BY pos), 0) - tax AS delta FROM t),
a AS (SELECT a.l_orderkey, a.pos, a.tax, sum(b.delta * power(0.99::DOUBLE * 0.95::DOUBLE, b.pos - a.pos)) AS adv FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND b.pos >= a.pos GROUP BY 1, 2, 3)
SELECT l_orderkey, pos, round(adv, 6) AS advantage, round(adv + tax, 6) AS returns FROM a""")
def gae(s, d):
    return A.gae(tokens(s, d), "l_orderkey", "pos", "discount", "tax", 0.99, 0.95).select("l_orderkey", "pos", F.round("advantage", 6).alias("advantage"), F.round("returns", 6).alias("returns"))


@query("agg_loss_modes", f"WITH {LINES}, q AS (SELECT l_orderkey, sum(discount * mask) AS total, sum(mask) AS tokens FROM l GROUP BY 1) SELECT round(sum(total) / sum(tokens), 6) AS token_mean, round(avg(total), 6) AS seq_mean_token_sum, round(avg(total / nullif(tokens, 0)), 6) AS seq_mean_token_mean, round(sum(total) / max(tokens), 4) AS seq_mean_token_sum_norm FROM q")
def losses(s, d):
    df = A.aggregate_loss(lines(s, d), "l_orderkey", "discount", "mask")
    return df.select(*[F.round(c, 4 if c.endswith("norm") else 6).alias(c) for c in df.columns])


@query("kl_penalty_kinds", f"WITH {LINES}, x AS (SELECT *, discount - tax AS v FROM l) SELECT l_orderkey, l_linenumber, l_partkey, round(v, 6) AS k1, round(abs(v), 6) AS k_abs, round(0.5::DOUBLE * v * v, 6) AS k2, round(exp(-v) + v - 1, 6) AS k3 FROM x")
def kls(s, d):
    return lines(s, d).select(*KEYS, *[F.round(A.kl_penalty("discount", "tax", k), 6).alias(n) for k, n in (("k1", "k1"), ("abs", "k_abs"), ("k2", "k2"), ("k3", "k3"))])


@query("ppo_clip_loss", f"""WITH {LINES}, x AS (SELECT *, hit - 0.5::DOUBLE AS a, exp(10 * (discount - tax)) AS r FROM l), y AS (SELECT *, -a * r AS p, -a * least(greatest(r, 0.8::DOUBLE), 1.2::DOUBLE) AS c FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN a < 0 THEN least(-a * 3, greatest(p, c)) ELSE greatest(p, c) END, 6) AS loss, CASE WHEN c > p THEN 1 ELSE 0 END AS clipped FROM y""")
def ppo(s, d):
    loss, cut = A.clipped_objective(F.col("hit") - 0.5, 10 * (F.col("discount") - F.col("tax")))
    return lines(s, d).select(*KEYS, F.round(loss, 6).alias("loss"), cut.cast("int").alias("clipped"))


@query("clipped_value_loss", f"""WITH {LINES}, x AS (SELECT *, least(greatest(discount * 10, tax * 10 - 0.2::DOUBLE), tax * 10 + 0.2::DOUBLE) AS c FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, round(0.5::DOUBLE * greatest((discount * 10 - hit) * (discount * 10 - hit), (c - hit) * (c - hit)), 6) AS loss FROM x""")
def value(s, d):
    loss, _ = A.value_loss(F.col("discount") * 10, F.col("tax") * 10, F.col("hit"), 0.2)
    return lines(s, d).select(*KEYS, F.round(loss, 6).alias("loss"))


CHAIN = f"{TOKENS}, z AS (SELECT *, sum(CASE WHEN mask > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS chain FROM t), r AS (SELECT a.l_orderkey, a.pos, a.mask, sum(b.reward * power(0.9::DOUBLE, b.pos - a.pos)) AS returns FROM z a JOIN z b ON a.l_orderkey = b.l_orderkey AND a.chain = b.chain AND b.pos >= a.pos GROUP BY 1, 2, 3), g AS (SELECT avg(returns) AS m, var_samp(returns) AS v FROM r WHERE mask > 0)"


@query("masked_returns", f"WITH {CHAIN} SELECT l_orderkey, pos, round(returns, 6) AS returns, round(CASE WHEN mask > 0 THEN (returns - m) / sqrt(v + 1e-8) ELSE 0 END, 6) AS advantage FROM r, g")
def masked_returns(s, d):
    r = A.discounted_returns(tokens(s, d), "l_orderkey", "pos", "reward", 0.9, mask="mask", whiten=True)
    return r.select("l_orderkey", "pos", F.round("returns", 6).alias("returns"), F.round("advantage", 6).alias("advantage"))


@query("gae_whitened", f"""WITH {TOKENS}, e AS (SELECT *, discount + 0.99::DOUBLE * coalesce(lead(tax) OVER (PARTITION BY l_orderkey ORDER BY pos), 0) - tax AS delta FROM t),
a AS (SELECT a.l_orderkey, a.pos, a.mask, sum(b.delta * power(0.99::DOUBLE * 0.95::DOUBLE, b.pos - a.pos)) AS adv FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND b.pos >= a.pos GROUP BY 1, 2, 3), g AS (SELECT avg(adv) AS m, var_samp(adv) AS v FROM a WHERE mask > 0)
SELECT l_orderkey, pos, round((adv - m) / sqrt(v + 1e-8), 6) AS advantage FROM a, g""")
def gae_whitened(s, d):
    r = A.gae(tokens(s, d), "l_orderkey", "pos", "discount", "tax", 0.99, 0.95, mask="mask", whiten=True)
    return r.select("l_orderkey", "pos", F.round("advantage", 6).alias("advantage"))


@query("positionwise_advantage", """WITH l AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice / 701 AS reward, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS mask FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, avg(reward) FILTER (mask > 0) OVER w AS m, stddev_samp(reward) FILTER (mask > 0) OVER w AS sd, count(*) FILTER (mask > 0) OVER w AS n FROM l WINDOW w AS (PARTITION BY o_custkey, l_linenumber))
SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, round(CASE WHEN mask = 0 THEN 0 ELSE (reward - CASE WHEN n <= 1 THEN 0 ELSE m END) / (CASE WHEN n <= 1 THEN 1 ELSE sd END + 1e-6) END, 5) AS advantage FROM g""")
def positionwise(s, d):
    rows = lines(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return A.positionwise(rows, "o_custkey", "l_linenumber", "reward", "mask").select("o_custkey", *KEYS, F.round("advantage", 5).alias("advantage"))


@query("outcome_and_steps", f"""WITH {TOKENS}, j AS (SELECT t.*, o_custkey, o_totalprice / 1000 AS outcome FROM t JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT *, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS sd, count(*) OVER w AS n FROM j WINDOW w AS (PARTITION BY o_custkey, pos)), st AS (SELECT *, (reward - CASE WHEN n <= 1 THEN 0 ELSE m END) / (CASE WHEN n <= 1 THEN 1 ELSE sd END + 1e-6) AS step FROM s),
q AS (SELECT DISTINCT o_custkey, l_orderkey, outcome FROM j), r AS (SELECT l_orderkey, (outcome - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(outcome) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(outcome) OVER w END + 1e-6) AS rel FROM q WINDOW w AS (PARTITION BY o_custkey)),
x AS (SELECT l_orderkey, pos, rel, CASE WHEN step * rel >= 0 THEN step ELSE step * 0.5 END AS step FROM st JOIN r USING (l_orderkey))
SELECT l_orderkey, pos, round(0.8::DOUBLE * rel + 0.2::DOUBLE * sum(step) OVER (PARTITION BY l_orderkey ORDER BY pos DESC), 5) AS advantage FROM x""")
def both(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", (F.col("o_totalprice") / 1000).alias("outcome"))
    rows = tokens(s, d).join(o, "l_orderkey").withColumn("all", F.lit(1))
    r = A.outcome_and_steps(rows, "o_custkey", "l_orderkey", "pos", "outcome", "reward", "all", differential="half")
    return r.select("l_orderkey", "pos", F.round("advantage", 5).alias("advantage"))


@query("long_returns", """WITH t AS (SELECT event_id, event_type, value / 701 AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos FROM events)
SELECT a.event_id, round(sum(b.v * power(0.5::DOUBLE, b.pos - a.pos)), 6) AS returns FROM t a JOIN t b ON a.event_type = b.event_type AND b.pos BETWEEN a.pos AND a.pos + 80 GROUP BY 1""")
def long_returns(s, d):
    """Five sequences of a fifth of the table each, in blocks; the SQL leaves out what weighs under 2^-80."""
    rows = table(s, d, "events").select("event_type", "event_id", (F.col("value") / 701).alias("v"))
    return A.discounted_returns(rows, "event_type", "event_id", "v", 0.5).select("event_id", F.round("returns", 6).alias("returns"))
