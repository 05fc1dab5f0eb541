"""Evaluation metrics and state distributions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as D
from ..operators import evaluation as E
from ..operators import logits as L
from ..operators import states as S
from ..operators.quantiles import exact_quantiles
from ..sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def hits(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("double").alias("hit"))


@query("solve_none_all_ratio", "WITH g AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS lo, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hi FROM lineitem GROUP BY 1) SELECT round(avg(CASE WHEN hi = 0 THEN 1::DOUBLE ELSE 0 END), 6) AS solve_none, round(avg(CASE WHEN lo = 1 THEN 1::DOUBLE ELSE 0 END), 6) AS solve_all FROM g")
def solve(s, d):
    return rounded(E.solve_ratios(hits(s, d), "l_orderkey", "hit"), "solve_none", "solve_all")


@query("prompt_filter", "WITH g AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'R' THEN 1::DOUBLE ELSE 0 END) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, round(m, 6) AS mean_reward, CASE WHEN m <= 0 THEN 'too_hard' WHEN m >= 0.75 THEN 'too_easy' ELSE 'useful' END AS verdict FROM g")
def prompts(s, d):
    return rounded(E.group_filter(hits(s, d), "l_orderkey", "hit", 0.75), "mean_reward")


@query("failure_breakdown", "SELECT l_linenumber, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) FILTER (l_returnflag = 'A') AS accepted, count(*) FILTER (l_returnflag = 'N') AS none_given FROM lineitem GROUP BY 1")
def failures(s, d):
    t = table(s, d, "lineitem")
    return rounded(t.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("accuracy"), F.count_if(F.col("l_returnflag") == "A").alias("accepted"), F.count_if(F.col("l_returnflag") == "N").alias("none_given")), "accuracy")


def orders(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("hit"))


def passk_sql(k: int) -> str:
    return f"CASE WHEN n - c < {k} THEN 1::DOUBLE ELSE 1 - list_reduce(list_prepend(1::DOUBLE, list_transform(range(CAST(least({k}, n) AS BIGINT)), lambda i: (n - c - i) / (n - i)::DOUBLE)), lambda a, b: a * b) END"


@query("pass_at_k", f"WITH g AS (SELECT o_custkey, count(*) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS c FROM orders GROUP BY 1) SELECT o_custkey, n, c, round({passk_sql(1)}, 6) AS pass_1, round({passk_sql(4)}, 6) AS pass_4, round({passk_sql(8)}, 6) AS pass_8 FROM g")
def passk(s, d):
    g = E.successes(orders(s, d), ["o_custkey"], "hit")
    return g.select("*", *[F.round(E.pass_at_k("n", "c", k), 6).alias(f"pass_{k}") for k in (1, 4, 8)])


@query("pass_at_k_decomposition", f"""WITH o AS (SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 0 ELSE 1 END AS half, o_orderstatus = 'F' AS hit FROM orders),
g AS (SELECT o_custkey, half, count(*) AS n, CAST(count(*) FILTER (hit) AS BIGINT) AS c FROM o GROUP BY 1, 2),
p AS (SELECT *, {passk_sql(4)} AS pk FROM g), j AS (SELECT a.pk AS before, b.pk AS after, CASE WHEN b.pk > a.pk THEN 'gained' WHEN b.pk < a.pk THEN 'lost' ELSE 'same' END AS category FROM p a JOIN p b USING (o_custkey) WHERE a.half = 0 AND b.half = 1)
SELECT category, count(*) AS n, round(sum(after - before) / (SELECT count(*) FROM j), 6) AS contribution FROM j GROUP BY 1""")
def decomposition(s, d):
    o = orders(s, d).withColumn("half", (F.col("o_orderdate") >= F.lit("1995-06-17").cast("timestamp")).cast("int"))
    p = E.successes(o, ["o_custkey", "half"], "hit").withColumn("pk", E.pass_at_k("n", "c", 4))
    j = p.filter("half = 0").select("o_custkey", F.col("pk").alias("before")).join(p.filter("half = 1").select("o_custkey", F.col("pk").alias("after")), "o_custkey")
    j = j.withColumn("category", F.when(F.col("after") > F.col("before"), "gained").when(F.col("after") < F.col("before"), "lost").otherwise("same"))
    g = j.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("after") - F.col("before")).alias("total"))
    every = j.agg(F.count(F.lit(1)).alias("every"))
    return g.crossJoin(F.broadcast(every)).select("category", "n", F.round(F.col("total") / F.col("every"), 6).alias("contribution"))


BEST = "list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * (power((i + 1)::DOUBLE / len(v), {n}) - power(i::DOUBLE / len(v), {n}))))"
WORST = "list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * (power((len(v) - i)::DOUBLE / len(v), {n}) - power((len(v) - 1 - i)::DOUBLE / len(v), {n}))))"


@query("validation_metrics", f"""WITH g AS (SELECT event_type, user_id, avg(value) AS m, stddev_pop(value) AS sd, list_sort(list(value)) AS v FROM events GROUP BY 1, 2)
SELECT event_type, round(avg(m), 5) AS mean, round(avg(sd), 5) AS std, round(avg({BEST.format(n=2)}), 5) AS best_2, round(avg({WORST.format(n=2)}), 5) AS worst_2, round(avg({BEST.format(n=4)}), 5) AS best_4, round(avg({WORST.format(n=4)}), 5) AS worst_4 FROM g GROUP BY 1""")
def validation(s, d):
    r = E.validation_metrics(table(s, d, "events"), "event_type", "user_id", "value")
    return rounded(r, *r.columns[1:], digits=5)


@query("maj_at_n", """WITH v AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY 1, 2, 3)
SELECT user_id, CAST(day AS VARCHAR) AS day, arg_max(event_type, votes * 1000000000 - f) AS majority, max(votes) AS votes, CAST(sum(votes) AS BIGINT) AS n FROM v GROUP BY 1, 2""")
def maj(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return E.majority(e, ["user_id", "day"], "event_type", "event_id")


@query("ttrl_majority", """WITH v AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY 1, 2), m AS (SELECT user_id, arg_max(event_type, votes * 1000000000 - f) AS label, max(votes) AS top, sum(votes) AS n FROM v GROUP BY 1)
SELECT e.user_id, label, round(avg(CASE WHEN event_type = label THEN 1::DOUBLE ELSE 0 END), 6) AS reward, round(any_value(top / n::DOUBLE), 6) AS ratio FROM events e JOIN m USING (user_id) GROUP BY 1, 2""")
def ttrl(s, d):
    e = table(s, d, "events")
    m = E.majority(e, ["user_id"], "event_type", "event_id")
    r = e.join(m, "user_id").groupBy("user_id", F.col("majority").alias("label")).agg(F.avg((F.col("event_type") == F.col("majority")).cast("double")).alias("reward"), F.max(F.col("votes") / F.col("n").cast("double")).alias("ratio"))
    return rounded(r, "reward", "ratio")


@query("mean_sem", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, count(value) AS n FROM events GROUP BY 1")
def sem(s, d):
    return rounded(E.mean_sem(table(s, d, "events"), "event_type", "value"), "mean", "sem")


@query("commit_quality", """WITH u AS (SELECT user_id, avg(value) AS a, CAST(count(*) AS DOUBLE) AS b FROM events GROUP BY 1), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM u)
SELECT user_id, round(a, 6) AS mean_value, b AS n_events, round(((a - ma) / sa + (b - mb) / sb) / 2, 6) AS composite FROM u, m""")
def quality(s, d):
    u = table(s, d, "events").groupBy("user_id").agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).cast("double").alias("n_events"))
    return rounded(E.composite_z(u, ["mean_value", "n_events"]), "mean_value", "composite")


@query("prompt_agreement", """WITH h AS (SELECT user_id, event_type, event_id % 2 AS half, avg(value) AS v FROM events GROUP BY 1, 2, 3), j AS (SELECT a.v AS a, b.v AS b FROM h a JOIN h b USING (user_id, event_type) WHERE a.half = 0 AND b.half = 1)
SELECT count(*) AS n, round(avg(abs(a - b)), 5) AS mean_abs_diff, round(max(abs(a - b)), 5) AS max_abs_diff, round(corr(a, b), 5) AS pearson FROM j HAVING count(*) >= 10""")
def agreement(s, d):
    e = table(s, d, "events")
    half = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    r = E.agreement(half(0), half(1), ["user_id", "event_type"], "v")
    return rounded(r, "mean_abs_diff", "max_abs_diff", "pearson", digits=5)


@query("label_accuracy", "SELECT lang, count(*) AS n, round(avg(CASE WHEN (regexp_matches(text, '[#|]|!!') AND quality = 0) OR (NOT regexp_matches(text, '[#|]|!!') AND quality = 1) THEN 1::DOUBLE ELSE 0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_accuracy(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("lang", "quality", (~F.col("text").rlike("[#|]|!!")).cast("int").alias("guess"))
    return rounded(E.accuracy(j, "guess", "quality", ["lang"]), "accuracy")


@query("norm_rank", "SELECT p_partkey, p_brand, rank, round((rank - 1) / greatest(n - 1, 1)::DOUBLE, 6) AS norm_rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def rank(s, d):
    return rounded(E.norm_rank(table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey").drop("p_retailprice"), "norm_rank")


@query("explained_variance", "SELECT round(1 - var_samp(l_tax - l_discount) / var_samp(l_tax), 6) AS explained_variance FROM lineitem")
def explained(s, d):
    return rounded(E.explained_variance(table(s, d, "lineitem"), "l_discount", "l_tax"), "explained_variance")


# states: users; traces: days; actions: event types


def days(s, d, half: int | None = None):
    e = table(s, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", "event_id")
    return e if half is None else e.filter(F.col("event_id") % 2 == half)


P = "p AS (SELECT user_id, day, event_type, w / sum(w) OVER (PARTITION BY user_id, day) AS p FROM (SELECT user_id, CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, event_type, CAST(count(*) AS DOUBLE) AS w FROM events {where} GROUP BY 1, 2, 3)), g AS (SELECT user_id, event_type, sum(p) / any_value(n) AS g FROM p JOIN (SELECT user_id, count(DISTINCT day) AS n FROM p GROUP BY 1) USING (user_id) GROUP BY 1, 2)"


@query("state_distribution", f"WITH {P.format(where='')} SELECT user_id, event_type, round(g, 6) AS g FROM g")
def state(s, d):
    p = S.distributions(days(s, d), "user_id", "day", "event_type")
    return rounded(S.marginals(p, "user_id", "day", "event_type"), "g")


@query("entropy_decomposition", f"WITH {P.format(where='')}, m AS (SELECT user_id, -sum(g * ln(g)) AS h_marginal FROM g GROUP BY 1), t AS (SELECT user_id, avg(h) AS h_traces, count(*) AS n_traces FROM (SELECT user_id, day, -sum(p * ln(p)) AS h FROM p GROUP BY 1, 2) GROUP BY 1) SELECT user_id, round(h_marginal, 6) AS h_marginal, round(h_traces, 6) + 0 AS h_traces, n_traces, round(greatest(h_marginal - h_traces, 0::DOUBLE), 6) AS sensitivity FROM m JOIN t USING (user_id)")
def entropy(s, d):
    p = S.distributions(days(s, d), "user_id", "day", "event_type")
    return rounded(S.entropy_table(p, "user_id", "day", "event_type"), "h_marginal", "h_traces", "sensitivity")


@query("trace_sensitivity", f"WITH {P.format(where='')} SELECT user_id, round(avg(kl), 6) AS sensitivity FROM (SELECT user_id, day, sum(p * ln(p / g)) AS kl FROM p JOIN g USING (user_id, event_type) GROUP BY 1, 2) GROUP BY 1")
def sensitivity(s, d):
    p = S.distributions(days(s, d), "user_id", "day", "event_type")
    return rounded(S.trace_sensitivity(p, "user_id", "day", "event_type"), "sensitivity")


def half_marginal(s, d, k):
    return S.marginals(S.distributions(days(s, d, k), "user_id", "day", "event_type"), "user_id", "day", "event_type")


def pairs(s, d):
    return S.align(half_marginal(s, d, 0), half_marginal(s, d, 1), "user_id", "event_type")


def _half(k: int) -> str:
    return P.format(where=f"WHERE event_id % 2 = {k}").replace("p AS (", f"p{k} AS (", 1).replace("g AS (SELECT user_id, event_type, sum(p)", f"g{k} AS (SELECT user_id, event_type, sum(p)").replace("FROM p ", f"FROM p{k} ")


PAIRS = f"{_half(0)}, {_half(1)}, j AS (SELECT user_id, event_type, coalesce(a.g, 0) AS p, coalesce(b.g, 0) AS q FROM (SELECT * FROM g0 WHERE user_id IN (SELECT user_id FROM g1)) a FULL JOIN (SELECT * FROM g1 WHERE user_id IN (SELECT user_id FROM g0)) b USING (user_id, event_type))"
KL = "sum(CASE WHEN {p} > 1e-12 THEN {p} * ln({p} / least(greatest({q}, 1e-12), 1)) ELSE 0 END)"


@query("stage_divergence", f"""WITH {PAIRS}, z AS (SELECT *, (p + q) / 2 AS m FROM j) SELECT user_id, round({KL.format(p='q', q='p')}, 5) AS kl_qp, round({KL.format(p='p', q='q')}, 5) AS kl_pq, round(({KL.format(p='p', q='m')} + {KL.format(p='q', q='m')}) / 2, 5) AS jsd,
round(-sum(CASE WHEN p > 1e-12 THEN p * ln(p) ELSE 0 END), 5) AS h_p, round(-sum(CASE WHEN q > 1e-12 THEN q * ln(q) ELSE 0 END), 5) AS h_q FROM z GROUP BY 1""")
def stage_divergence(s, d):
    r = S.divergences(pairs(s, d), "user_id", "event_type")
    return rounded(r, *r.columns[1:], digits=5)


@query("sharpening_loglin", f"WITH {PAIRS} SELECT round(regr_slope(ln(q), ln(p)), 5) AS slope, round(regr_intercept(ln(q), ln(p)), 5) AS intercept, round(regr_r2(ln(q), ln(p)), 5) AS r2, count(*) AS n FROM j WHERE p > 1e-12 AND q > 1e-12")
def loglin(s, d):
    return rounded(S.log_ratio_fit(pairs(s, d)), "slope", "intercept", "r2", digits=5)


GRID = [0.5, 0.75, 1.0, 1.25, 1.5]


@query("alpha_star_grid", f"WITH {PAIRS}, a AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS alpha), x AS (SELECT alpha, user_id, event_type, q, power(least(greatest(p, 1e-12), 1), alpha) AS r FROM j, a), y AS (SELECT *, r / sum(r) OVER (PARTITION BY alpha, user_id) AS pr, q / sum(q) OVER (PARTITION BY alpha, user_id) AS qr FROM x) SELECT alpha, round(avg(kl), 5) AS loss FROM (SELECT alpha, user_id, {KL.format(p='qr', q='pr')} AS kl FROM y GROUP BY 1, 2) GROUP BY 1")
def alpha_grid(s, d):
    return rounded(S.power_loss(pairs(s, d), "user_id", "event_type", GRID), "loss", digits=5)


@query("embedding_softmax_entropy", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS t FROM e), z AS (SELECT vec_id, v, t, list_sum(list_transform(v, lambda x: exp(x - t))) AS z FROM m) SELECT vec_id, round(t + ln(z) - list_sum(list_transform(v, lambda x: exp(x - t) / z * x)), 5) AS entropy, round(t + ln(z) - list_sum(v) / len(v), 5) AS self_certainty FROM z")
def embedding(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(D.entropy_from_logits(F.col("v")), 5).alias("entropy"), F.round(D.self_certainty(F.col("v")), 5).alias("self_certainty"))


@query("chunked_entropies", "WITH e AS (SELECT vec_id, list_transform(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)), lambda x: x::DOUBLE * 400) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS t FROM e WHERE len(v) > 0), z AS (SELECT vec_id, v, t, list_sum(list_transform(v, lambda x: exp(x - t))) AS z FROM m) SELECT vec_id, round(ln(z) - list_sum(list_transform(v, lambda x: exp(x - t) / z * (x - t))), 5) AS entropy, round(t + ln(z) - list_sum(v) / len(v), 5) AS self_certainty FROM z")
def chunked(s, d):
    finite = F.filter("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(s, d, "embeddings").select("vec_id", F.transform(finite, lambda x: x.cast("double") * 400).alias("v"))
    return rounded(L.chunked_entropies(L.in_chunks(rows, ["vec_id"], "v", 16), ["vec_id"], "v"), "entropy", "self_certainty", digits=5)


@query("whole_table_quantiles", "SELECT unnest(['l_extendedprice', 'l_quantity', 'l_discount']) AS metric, unnest([round(quantile_cont(l_extendedprice, 0.25), 6), round(quantile_cont(l_quantity, 0.25), 6), round(quantile_cont(l_discount, 0.25), 6)]) AS q25, unnest([round(quantile_cont(l_extendedprice, 0.5), 6), round(quantile_cont(l_quantity, 0.5), 6), round(quantile_cont(l_discount, 0.5), 6)]) AS median, unnest([round(quantile_cont(l_extendedprice, 0.999), 6), round(quantile_cont(l_quantity, 0.999), 6), round(quantile_cont(l_discount, 0.999), 6)]) AS q999 FROM lineitem")
def whole_quantiles(s, d):
    rows = table(s, d, "lineitem")
    found = [(c, *exact_quantiles(rows, c, [0.25, 0.5, 0.999])) for c in ("l_extendedprice", "l_quantity", "l_discount")]
    return rounded(s.createDataFrame(found, "metric string, q25 double, median double, q999 double"), "q25", "median", "q999")


@query("masked_stats", "SELECT l_returnflag, round(avg(l_tax) FILTER (l_linestatus = 'O'), 6) AS l_tax_mean, max(l_tax) FILTER (l_linestatus = 'O') AS l_tax_max, min(l_tax) FILTER (l_linestatus = 'O') AS l_tax_min, round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS l_discount_mean, max(l_discount) FILTER (l_linestatus = 'O') AS l_discount_max, min(l_discount) FILTER (l_linestatus = 'O') AS l_discount_min FROM lineitem GROUP BY 1")
def masked_stats(s, d):
    t = table(s, d, "lineitem").withColumn("mask", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(E.masked_stats(t, ["l_tax", "l_discount"], "mask", ["l_returnflag"]), "l_tax_mean", "l_discount_mean")


@query("length_stats", "SELECT lang, round(avg(n_chars), 5) AS mean, max(n_chars) AS max, min(n_chars) AS min, round(avg(CASE WHEN n_chars >= 2000 THEN 1::DOUBLE ELSE 0 END), 6) AS clip_ratio FROM documents GROUP BY 1")
def length_stats(s, d):
    return rounded(rounded(E.length_stats(table(s, d, "documents"), "n_chars", 2000, ["lang"]), "mean", digits=5), "clip_ratio")


@query("label_metrics", "WITH g AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1::DOUBLE ELSE 0 END) AS p, max(CASE WHEN l_orderkey % 3 = l_orderkey % 5 THEN 1::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN (l_returnflag = 'R') = (l_linestatus = 'O') THEN 1::DOUBLE ELSE 0 END) AS r, avg(CASE WHEN l_linestatus = 'O' THEN 1::DOUBLE ELSE 0 END) AS m, avg(CASE WHEN l_returnflag = 'R' THEN 1::DOUBLE ELSE 0 END) AS t FROM lineitem GROUP BY 1) SELECT round(avg(a), 6) AS label_accuracy, round(avg(r), 6) AS reward_accuracy, round(avg(m), 6) AS majority_reward, round(avg(t), 6) AS truth_reward, round(avg(p), 6) AS pass_at_n FROM g")
def label_metrics(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 3).alias("a"), (F.col("l_orderkey") % 5).alias("b"), (F.col("l_linestatus") == "O").cast("double").alias("m"), (F.col("l_returnflag") == "R").cast("double").alias("t"))
    r = E.label_metrics(t, "l_orderkey", "a", "b", "m", "t")
    return rounded(r, *r.columns)
