"""What changes between two stages of a state's distribution, and a model's scores, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model_scores as Y
from ..operators import stages as G
from ..operators import states as S
from ..sources.tables import table
from .evaluation_queries import PAIRS, _half, days, half_marginal, pairs

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df, *cols, digits=5):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


TRUTH = "truth AS (SELECT user_id, arg_max(event_type, c * 100 + rank) AS truth FROM (SELECT user_id, event_type, count(*) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS rank FROM events GROUP BY 1, 2) GROUP BY 1)"


def truth(s, d):
    votes = table(s, d, "events").groupBy("user_id", "event_type").count()
    return votes.groupBy("user_id").agg(F.max_by("event_type", F.struct("count", "event_type")).alias("truth"))


def marginal(s, d, half):
    """Shares are rounded so that equal ones tie in every engine."""
    return half_marginal(s, d, half).withColumn("g", F.round("g", 9))


R0, R1 = ("r{k} AS (SELECT user_id, event_type, round(g, 9) AS g FROM g{k})".format(k=k) for k in (0, 1))
METRICS = "t{k} AS (SELECT r.user_id, truth, coalesce(max(g) FILTER (event_type = truth), 0) AS pi, max(g) FILTER (event_type <> truth) AS other, count(*) FILTER (g > own) AS above FROM (SELECT r{k}.*, truth, max(g) FILTER (event_type = truth) OVER (PARTITION BY r{k}.user_id) AS own FROM r{k} JOIN truth USING (user_id)) r GROUP BY 1, 2)"
T0, T1 = METRICS.format(k=0), METRICS.format(k=1)
MODE = "m{k} AS (SELECT user_id, (list(event_type ORDER BY g DESC, event_type))[1] AS mode, max(g) AS mode_p FROM r{k} GROUP BY 1)"
BASE = f"{_half(0)}, {_half(1)}, {TRUTH}, {R0}, {R1}, {T0}, {T1}, {MODE.format(k=0)}"
RANK = "CASE WHEN pi > 0 THEN above + 1 ELSE 9999 END"


@query("truth_metrics", f"WITH {BASE} SELECT user_id, truth, round(pi, 6) AS pi, CAST({RANK} AS INT) AS rank, CASE WHEN pi > 0 THEN round(ln(greatest(pi, 1e-12::DOUBLE)) - ln(greatest(coalesce(other, 1e-12::DOUBLE), 1e-12::DOUBLE)), 5) END AS margin FROM t0")
def metrics(s, d):
    r = G.truth_metrics(marginal(s, d, 0), truth(s, d), ["user_id"], "user_id", "event_type", "g")
    return r.select("user_id", "truth", F.round("pi", 6).alias("pi"), "rank", F.round("margin", 5).alias("margin"))


@query("trace_truth_ranks", f"WITH {_half(0)}, {TRUTH}, q AS (SELECT user_id, day, event_type, round(p, 9) AS p, truth, round(max(p) FILTER (event_type = truth) OVER (PARTITION BY user_id, day), 9) AS own FROM p0 JOIN truth USING (user_id)) SELECT user_id, day, round(coalesce(max(own), 0), 6) AS pi, CAST(CASE WHEN max(own) > 0 THEN count(*) FILTER (p > own) + 1 ELSE 9999 END AS INT) AS rank FROM q GROUP BY 1, 2")
def trace_ranks(s, d):
    p = S.distributions(days(s, d, 0), "user_id", "day", "event_type").withColumn("p", F.round("p", 9))
    r = G.truth_metrics(p, truth(s, d), ["user_id", "day"], "user_id", "event_type", "p")
    return r.select("user_id", "day", F.round("pi", 6).alias("pi"), "rank")


WRONG = "x AS (SELECT m0.user_id, mode_p AS ps, max(g) FILTER (event_type = mode) AS pq, max(g) FILTER (event_type = mode) IS NOT NULL AS has FROM m0 JOIN r1 USING (user_id) GROUP BY 1, 2), y AS (SELECT x.user_id, ps, pq, count(*) FILTER (g > pq) + 1 AS rank FROM x JOIN r1 USING (user_id) WHERE has GROUP BY 1, 2, 3)"
CATEGORY = f"""{BASE}, {WRONG}, z AS (SELECT t0.user_id, t0.truth, t0.pi AS p_before, t1.pi AS p_after, CASE WHEN t0.pi > 0 THEN t0.above + 1 ELSE 9999 END AS rank_before, CASE WHEN t1.pi > 0 THEN t1.above + 1 ELSE 9999 END AS rank_after, y.rank AS mode_rank, pq - ps AS wd FROM t0 JOIN t1 USING (user_id) LEFT JOIN y USING (user_id)),
c AS (SELECT *, p_after - p_before AS delta, CASE WHEN rank_before > {{k}} AND rank_after > {{k}} AND mode_rank <= {{k}} THEN wd END AS wrong_delta FROM z),
e AS (SELECT *, CASE WHEN rank_before <= {{k}} AND rank_after <= {{k}} AND delta > 0 THEN 'gt_amplification' WHEN rank_before > {{k}} AND rank_after <= {{k}} AND p_before < 0.05 THEN 'tail_discovery' WHEN rank_before > {{k}} AND rank_after <= {{k}} THEN 'topk_correction' WHEN rank_before <= {{k}} AND rank_after > {{k}} THEN 'gt_regression' WHEN wrong_delta > 0 THEN 'wrong_mode_amplification' ELSE 'other' END AS category FROM c)"""
SEVERITY = "round(CASE category WHEN 'wrong_mode_amplification' THEN abs(wrong_delta) WHEN 'tail_discovery' THEN p_after WHEN 'topk_correction' THEN p_after ELSE abs(delta) END, 5)"


def categories(s, d, k=1):
    return G.transition_categories(marginal(s, d, 0), marginal(s, d, 1), truth(s, d), "user_id", "event_type", "g", k)


@query("transition_categories", f"WITH {CATEGORY.format(k=1)} SELECT user_id, truth, CAST(rank_before AS INT) AS rank_before, CAST(rank_after AS INT) AS rank_after, round(delta, 5) AS delta, category, {SEVERITY} AS severity FROM e")
def transitions(s, d):
    r = categories(s, d).select("user_id", "truth", "rank_before", "rank_after", "delta", "category", "severity")
    return rounded(r, "delta", "severity")


@query("transition_categories_top2", f"WITH {CATEGORY.format(k=2)} SELECT user_id, category, {SEVERITY} AS severity FROM e")
def transitions_top(s, d):
    return rounded(categories(s, d, 2).select("user_id", "category", "severity"), "severity")


@query("category_fractions", f"WITH {CATEGORY.format(k=1)} SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM e GROUP BY 1")
def fractions(s, d):
    from pyspark.sql.window import Window

    c = categories(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return c.select("category", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("fraction"))


JSD = "greatest(0.5::DOUBLE * sum(CASE WHEN a > 1e-12 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 1e-12 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END), 0)"


@query("trace_collapse", f"""WITH {BASE}, u AS (SELECT DISTINCT user_id FROM g0 JOIN g1 USING (user_id)),
ev AS (SELECT user_id, event_type FROM g0 UNION SELECT user_id, event_type FROM g1),
dm AS (SELECT user_id, {JSD} AS d_marginal FROM (SELECT ev.user_id, coalesce(g0.g, 0) AS a, coalesce(g1.g, 0) AS b FROM ev LEFT JOIN g0 USING (user_id, event_type) LEFT JOIN g1 USING (user_id, event_type)) GROUP BY 1),
dt AS (SELECT user_id, day, {JSD} AS d FROM (SELECT k.user_id, k.day, coalesce(p0.p, 0) AS a, coalesce(g1.g, 0) AS b FROM (SELECT DISTINCT p0.user_id, p0.day, ev.event_type FROM p0 JOIN ev USING (user_id)) k LEFT JOIN p0 USING (user_id, day, event_type) LEFT JOIN g1 ON g1.user_id = k.user_id AND g1.event_type = k.event_type) GROUP BY 1, 2),
n AS (SELECT user_id, min(d) AS d_trace, (list(day ORDER BY round(d, 9), day))[1] AS nearest FROM dt GROUP BY 1),
tm AS (SELECT user_id, day AS nearest, (list(event_type ORDER BY round(p, 9) DESC, event_type))[1] AS nearest_mode FROM p0 GROUP BY 1, 2)
SELECT user_id, round(d_marginal, 5) AS d_marginal, round(d_trace, 5) AS d_trace, round(d_marginal - d_trace, 5) AS c_trace, nearest, nearest_mode, nearest_mode = truth AS mode_is_truth FROM u JOIN dm USING (user_id) JOIN n USING (user_id) JOIN tm USING (user_id, nearest) JOIN truth USING (user_id)""")
def collapse(s, d):
    p = S.distributions(days(s, d, 0), "user_id", "day", "event_type")
    r = G.trace_collapse(half_marginal(s, d, 1), half_marginal(s, d, 0), p, truth(s, d), "user_id", "day", "event_type", 9)
    return rounded(r, "d_marginal", "d_trace", "c_trace")


POINTS = 26


@query("alpha_per_state", f"""WITH {PAIRS}, a AS (SELECT range * 0.2::DOUBLE AS alpha FROM range({POINTS})), x AS (SELECT alpha, user_id, event_type, p, q, power(least(greatest(p, 1e-12::DOUBLE), 1), alpha) AS r FROM j, a),
y AS (SELECT *, r / sum(r) OVER w AS pr, q / sum(q) OVER w AS qr FROM x WINDOW w AS (PARTITION BY alpha, user_id)), l AS (SELECT alpha, user_id, sum(CASE WHEN qr > 1e-12 THEN qr * ln(qr / least(greatest(pr, 1e-12::DOUBLE), 1)) ELSE 0 END) AS loss, 0.5::DOUBLE * sum(CASE WHEN qr > 1e-12 THEN qr * ln(qr / ((qr + pr) / 2)) ELSE 0 END + CASE WHEN pr > 1e-12 THEN pr * ln(pr / ((qr + pr) / 2)) ELSE 0 END) AS jsd FROM y GROUP BY 1, 2)
SELECT user_id, round(min(loss), 5) AS loss FROM l GROUP BY 1""")
def alphas(s, d):
    from ..functions import distributions as D

    v = S.aligned_arrays(pairs(s, d), "user_id", "event_type")
    best = G.alpha_per_state(v, "user_id", rounds=1, points=POINTS).select("user_id", "alpha")
    r = v.join(best, "user_id").select("user_id", D.kl(F.col("q"), D.power(F.col("p"), F.col("alpha"))).alias("loss"))
    return rounded(r, "loss")


@query("first_turn_scan", "SELECT conv_id, role, length(text) AS n FROM conversations WHERE turn = 0 AND starts_with(role, 'sys')")
def first(s, d):
    return G.first_turns(table(s, d, "conversations").select("conv_id", "turn", "role", "text"), "turn", "role", "sys").select("conv_id", "role", F.length("text").alias("n"))


@query("shared_brackets", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000)")
def brackets(s, d):
    from ..operators.batch import shared

    o = table(s, d, "orders")
    both = shared([o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P' and o_totalprice > 250000")], "o_orderpriority")
    return G.in_brackets(o.select("o_orderkey", "o_orderpriority"), "o_orderpriority", both).select("o_orderkey")


@query("sensitivity_summary", f"WITH {_half(0)}, k AS (SELECT user_id, day, sum(CASE WHEN p > 1e-12 THEN p * ln(p / g) ELSE 0 END) AS kl FROM p0 JOIN g0 USING (user_id, event_type) GROUP BY 1, 2), t AS (SELECT user_id, avg(kl) AS s FROM k GROUP BY 1) SELECT round(avg(s), 5) AS mean, round(quantile_cont(s, 0.5), 5) AS median, count(*) AS n FROM t")
def sensitivity(s, d):
    p = S.distributions(days(s, d, 0), "user_id", "day", "event_type")
    return rounded(G.trace_summary(S.trace_sensitivity(p, "user_id", "day", "event_type"), "user_id", "sensitivity"), "mean", "median")


# a model's scores: lines of an order are positions' moves, tokens are quantities


TOKENS = "k AS (SELECT l_orderkey, l_partkey, sum(-10 * l_discount) AS l FROM lineitem GROUP BY 1, 2), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY l_orderkey)) AS e FROM k), p AS (SELECT l_orderkey, l_partkey, e / sum(e) OVER (PARTITION BY l_orderkey) AS p FROM e)"


def policy(s, d):
    return Y.move_policy(table(s, d, "lineitem").withColumn("lp", -10 * F.col("l_discount")), ["l_orderkey"], ["l_partkey"], "lp")


@query("move_policy", f"WITH {TOKENS} SELECT l_orderkey, l_partkey, round(p, 6) AS p FROM p")
def move_policy(s, d):
    return rounded(policy(s, d), "p", digits=6)


@query("policy_entropy", f"WITH {TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC) AS k FROM p), o AS (SELECT l_orderkey, -sum(p * ln(p + 1e-9)) AS h, sum(p) FILTER (k <= 1) AS t1, sum(p) FILTER (k <= 5) AS t5 FROM r GROUP BY 1) SELECT round(avg(h), 5) AS entropy, round(avg(t1), 5) AS top1_mass, round(avg(t5), 5) AS top5_mass, count(*) AS n_positions FROM o")
def policy_entropy(s, d):
    return rounded(Y.policy_entropy(policy(s, d), ["l_orderkey"]), "entropy", "top1_mass", "top5_mass")


@query("engine_divergence", f"WITH {TOKENS}, c AS (SELECT p.*, max(l_extendedprice) / 100 AS cp FROM p JOIN lineitem USING (l_orderkey, l_partkey) GROUP BY ALL), q AS (SELECT *, exp((cp - max(cp) OVER w) / 100) AS e FROM c WINDOW w AS (PARTITION BY l_orderkey)), z AS (SELECT *, e / sum(e) OVER (PARTITION BY l_orderkey) AS q FROM q), o AS (SELECT l_orderkey, sum(p * ln(p / greatest(q, 1e-12))) AS kl, count(*) AS n FROM z GROUP BY 1) SELECT round(avg(kl / ln(n)), 5) AS normalised_kl, count(*) AS n_positions FROM o WHERE n > 1")
def divergence(s, d):
    scores = table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg((F.max("l_extendedprice") / 100).alias("cp"))
    return rounded(Y.engine_divergence(policy(s, d), scores, ["l_orderkey"], ["l_partkey"], "cp"), "normalised_kl")


@query("held_out_loss", "SELECT l_returnflag, round(avg(l_tax), 6) AS loss, round(avg(l_discount), 6) AS entropy, count(*) AS n_tokens FROM lineitem GROUP BY 1")
def held_out(s, d):
    return rounded(Y.held_out(table(s, d, "lineitem"), "l_tax", "l_discount", ["l_returnflag"]), "loss", "entropy", digits=6)
