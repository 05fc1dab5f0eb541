"""Per-state action distributions and what changes between two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D


def distributions(df: DataFrame, state: str, trace: str, action: str, weight: str | None = None) -> DataFrame:
    """Long form (state, trace, action, p): the share of each action in a trace."""
    w = F.sum(weight).cast("double") if weight else F.count(F.lit(1)).cast("double")
    c = df.groupBy(state, trace, action).agg(w.alias("w"))
    return c.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(state, trace))).drop("w")


def marginals(p: DataFrame, state: str, trace: str, action: str) -> DataFrame:
    """(state, action, g): the mean of the traces' shares; an action that a trace lacks counts 0.

    A trace's shares sum to 1, so a state's shares sum to the number of its traces: one pass, and one row per action in the window.
    """
    totals = p.groupBy(state, action).agg(F.sum("p").alias("_total"))
    n = F.round(F.sum("_total").over(Window.partitionBy(state)))
    return totals.select(state, action, (F.col("_total") / n).alias("g"))


def vectors(p: DataFrame, keys: list[str], action: str, value: str, name: str) -> DataFrame:
    """One row per key with a map from action to probability; a state's vocabulary is bounded by its legal actions."""
    return p.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(action, value)))).alias(name))


def entropy_table(p: DataFrame, state: str, trace: str, action: str) -> DataFrame:
    """Per state: entropy of the marginal, mean entropy of the traces, and their difference, at least 0."""
    h = lambda c: -F.sum(F.when(F.col(c) > 1e-12, F.col(c) * F.ln(c)).otherwise(0.0))
    m = marginals(p, state, trace, action).groupBy(state).agg(h("g").alias("h_marginal"))
    t = p.groupBy(state, trace).agg(h("p").alias("h")).groupBy(state).agg(F.avg("h").alias("h_traces"), F.count(F.lit(1)).alias("n_traces"))
    return m.join(t, state).withColumn("sensitivity", F.greatest(F.col("h_marginal") - F.col("h_traces"), F.lit(0.0)))


def trace_sensitivity(p: DataFrame, state: str, trace: str, action: str) -> DataFrame:
    """Per state the mean KL divergence of its traces to the marginal."""
    g = marginals(p, state, trace, action)
    terms = p.join(g, [state, action]).withColumn("t", F.when(F.col("p") > 1e-12, F.col("p") * F.ln(F.col("p") / F.col("g"))).otherwise(0.0))
    return terms.groupBy(state, trace).agg(F.sum("t").alias("kl")).groupBy(state).agg(F.avg("kl").alias("sensitivity"))


def align(a: DataFrame, b: DataFrame, state: str, action: str) -> DataFrame:
    """Two marginals over the union of their actions, states of both stages only; missing actions are 0. Each side is read once, and one shuffle by state serves both steps."""
    none, some = F.lit(0.0), F.col("g")
    both = a.select(state, action, some.alias("p"), none.alias("q"), F.lit(1).alias("_side")).unionByName(b.select(state, action, none.alias("p"), some.alias("q"), F.lit(2).alias("_side")))
    rows = both.repartition(state).groupBy(state, action).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    w = Window.partitionBy(state)
    return rows.withColumn("_in_both", (F.min("_low").over(w) == 1) & (F.max("_high").over(w) == 2)).filter("_in_both").select(state, action, "p", "q")


def aligned_arrays(pairs: DataFrame, state: str, action: str) -> DataFrame:
    s = pairs.groupBy(state).agg(F.array_sort(F.collect_list(F.struct(action, "p", "q"))).alias("_seq"))
    return s.select(state, F.col(f"_seq.{action}").alias("actions"), F.col("_seq.p").alias("p"), F.col("_seq.q").alias("q"))


def divergences(pairs: DataFrame, state: str, action: str) -> DataFrame:
    v = aligned_arrays(pairs, state, action)
    p, q = F.col("p"), F.col("q")
    return v.select(state, D.kl(q, p).alias("kl_qp"), D.kl(p, q).alias("kl_pq"), D.jsd(p, q).alias("jsd"), D.entropy(p).alias("h_p"), D.entropy(q).alias("h_q"))


def power_loss(pairs: DataFrame, state: str, action: str, grid: list[float]) -> DataFrame:
    """(alpha, loss): the mean over states of KL(q || p^alpha / Z) for each alpha of a grid; one pass for the whole grid."""
    v = aligned_arrays(pairs, state, action)
    losses = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), D.kl(F.col("q"), D.power(F.col("p"), a)).alias("loss")) for a in grid])
    return v.select(F.explode(losses).alias("x")).groupBy("x.alpha").agg(F.avg("x.loss").alias("loss"))


def best_alpha(pairs: DataFrame, state: str, action: str, most: float = 5.0, rounds: int = 3, points: int = 41) -> float:
    """The alpha that minimises the mean loss: a grid whose bracket shrinks; three passes over aligned arrays."""
    low, high = 0.0, most
    for _ in range(rounds):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        rows = {r["alpha"]: r["loss"] for r in power_loss(pairs, state, action, grid).collect()}  # one row a point
        best = min(rows, key=lambda a: (rows[a], a))
        step = (high - low) / (points - 1)
        low, high = max(0.0, best - step), min(most, best + step)
    return best


def at_boundary(alpha: float, most: float = 5.0, near: float = 0.05) -> bool:
    """Whether a fitted alpha lies at an end of its range, so that the fit says little."""
    return alpha <= near or alpha >= most - near


def log_ratio_fit(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least squares of ln q on ln p over the points where both are positive."""
    pts = pairs.filter("p > 1e-12 and q > 1e-12").withColumns({"x": F.ln("p"), "y": F.ln("q")})
    g = pts.groupBy(*by) if by else pts.groupBy()
    return g.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"))
