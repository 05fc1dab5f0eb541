"""What training changes in a state's action distribution: truth metrics, transition categories, collapse on one trace, sharpening by state.

Long tables in (state, action, probability); one row per state out. Ties between modes go to the smaller action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from .quantiles import exact_quantiles

#: The categories of a transition in order, and the rank of a truth that is no action.
CATEGORIES = ("gt_amplification", "tail_discovery", "topk_correction", "gt_regression", "wrong_mode_amplification", "other")
ABSENT = 9999


def first_turns(df: DataFrame, turn: str, source: str, prefix: str = "test_B") -> DataFrame:
    """Rows of the first turn whose source has the prefix: both filters and the columns reach the scan."""
    return df.filter((F.col(turn) == 0) & F.col(source).startswith(prefix))


def in_brackets(df: DataFrame, bracket: str, brackets: list[str] | DataFrame) -> DataFrame:
    """Rows of the brackets that all stages share."""
    return df.filter(F.col(bracket).isin(brackets)) if isinstance(brackets, list) else df.join(brackets.select(bracket).distinct(), bracket, "left_semi")


def truth_metrics(p: DataFrame, truth: DataFrame, keys: list[str], state: str, action: str, value: str) -> DataFrame:
    """Per key (a state, or a state and trace): the truth's probability, its rank (1 + the actions above it) and its log margin to the best other action.

    truth: (state, truth). Without probability the rank is ABSENT and the margin NULL.
    """
    rows = p.join(truth, state)
    is_truth = F.col(action) == F.col("truth")
    w = Window.partitionBy(*keys)
    own = F.max(F.when(is_truth, F.col(value))).over(w)
    marked = rows.select(*keys, "truth", action, F.col(value).alias("_p"), own.alias("_own"))
    other = F.max(F.when(F.col(action) != F.col("truth"), F.col("_p")))
    out = marked.groupBy(*keys, "truth").agg(F.coalesce(F.max("_own"), F.lit(0.0)).alias("pi"), F.count_if(F.col("_p") > F.col("_own")).alias("_above"), other.alias("_other"))
    has = F.col("pi") > 0
    log = lambda c: F.ln(F.greatest(c, F.lit(D.TINY)))
    return out.select(*keys, "truth", "pi", F.when(has, F.col("_above") + 1).otherwise(ABSENT).cast("int").alias("rank"), F.when(has, log(F.col("pi")) - log(F.coalesce("_other", F.lit(D.TINY)))).alias("margin"))


def modes(p: DataFrame, keys: list[str], action: str, value: str) -> DataFrame:
    """(keys, mode, mode_p): the likeliest action, ties to the smaller one."""
    order = F.struct(-F.col(value), F.col(action))
    return p.groupBy(*keys).agg(F.min_by(action, order).alias("mode"), F.max(value).alias("mode_p"))


def mode_rank(source: DataFrame, target: DataFrame, state: str, action: str, value: str) -> DataFrame:
    """(state, mode, p_source, p_target, rank): the competition rank, under the target, of the source's mode; states whose target lacks the mode are left out."""
    m = modes(source, [state], action, value)
    rows = target.select(state, action, F.col(value).alias("_q")).join(m, state)
    at = F.max(F.when(F.col(action) == F.col("mode"), F.col("_q"))).over(Window.partitionBy(state))
    rows = rows.withColumn("_at", at).filter(F.col("_at").isNotNull())
    return rows.groupBy(state, "mode", F.col("mode_p").alias("p_source"), F.col("_at").alias("p_target")).agg((F.count_if(F.col("_q") > F.col("_at")) + 1).cast("int").alias("rank"))


def transition_categories(before: DataFrame, after: DataFrame, truth: DataFrame, state: str, action: str, value: str, top_k: int = 1, tail: float = 0.05) -> DataFrame:
    """One of CATEGORIES for each state of both stages, with the numbers behind it and a severity.

    In the top k before and after, and likelier: amplification; from outside into it: discovery from the tail or correction; out of it: regression;
    outside both times with the old mode in the new top k and likelier: the wrong mode's amplification; else other.
    """
    columns = lambda d, s: truth_metrics(d, truth, [state], state, action, value).select(state, "truth", F.col("pi").alias(f"p_{s}"), F.col("rank").alias(f"rank_{s}"))
    rows = columns(before, "before").join(columns(after, "after").drop("truth"), state)
    wrong = mode_rank(before, after, state, action, value).select(state, F.col("rank").alias("_mode_rank"), (F.col("p_target") - F.col("p_source")).alias("_delta"))
    rows = rows.join(wrong, state, "left")
    delta = F.col("p_after") - F.col("p_before")
    was, now = F.col("rank_before") <= top_k, F.col("rank_after") <= top_k
    wrong_delta = F.when(~was & ~now & (F.col("_mode_rank") <= top_k), F.col("_delta"))
    category = (
        F.when(was & now & (delta > 0), CATEGORIES[0])
        .when(~was & now & (F.col("p_before") < tail), CATEGORIES[1])
        .when(~was & now, CATEGORIES[2])
        .when(was & ~now, CATEGORIES[3])
        .when(wrong_delta > 0, CATEGORIES[4])
        .otherwise(CATEGORIES[5])
    )
    rows = rows.select(state, "truth", "p_before", "p_after", "rank_before", "rank_after", delta.alias("delta"), wrong_delta.alias("wrong_delta"), category.alias("category"))
    severity = F.when(F.col("category") == CATEGORIES[4], F.abs("wrong_delta")).when(F.col("category").isin(CATEGORIES[1], CATEGORIES[2]), F.col("p_after")).otherwise(F.abs("delta"))
    return rows.withColumn("severity", severity)


def trace_collapse(marginal: DataFrame, old_marginal: DataFrame, old_traces: DataFrame, truth: DataFrame, state: str, trace: str, action: str, digits: int = 12) -> DataFrame:
    """Per state of both stages: the divergence (Jensen-Shannon) of the new marginal to the old one and to its nearest old trace, their
    difference, that trace, its mode and whether this is the truth. Distances equal to ``digits`` places tie to the smaller trace.

    marginal and old_marginal: (state, action, g); old_traces: (state, trace, action, p). Sums over pairs of shared actions; the rest of
    either side adds its mass times ln 2, so no union of vocabularies is built.
    """
    half = lambda a, b: F.when(a > D.TINY, a * F.ln(a / ((a + b) / 2))).otherwise(0.0)

    def distance(rows: DataFrame, keys: list[str], p: str) -> DataFrame:
        """JSD of ``p`` by keys to the new marginal: ln 2 for mass without partner, per-action terms for shared actions."""
        shared = rows.join(marginal.select(state, action, F.col("g").alias("_q")), [state, action])
        a, b = F.col(p), F.col("_q")
        return shared.groupBy(*keys).agg(F.sum((half(a, b) + half(b, a)) / 2).alias("_shared"), F.sum(a).alias("_a"), F.sum(b).alias("_b"))

    def completed(all_keys: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        d = F.coalesce("_shared", F.lit(0.0)) + ((1 - F.coalesce("_a", F.lit(0.0))) + (1 - F.coalesce("_b", F.lit(0.0)))) * 0.5 * F.ln(F.lit(2.0))
        return all_keys.join(found, keys, "left").select(*keys, F.greatest(d, F.lit(0.0)).alias("d"))

    both = marginal.select(state).distinct().join(old_marginal.select(state).distinct(), state, "left_semi")
    d_marginal = completed(both, distance(old_marginal, [state], "g"), [state]).withColumnRenamed("d", "d_marginal")
    traces = old_traces.join(both, state, "left_semi")
    each = completed(traces.select(state, trace).distinct(), distance(traces, [state, trace], "p"), [state, trace])
    near = each.groupBy(state).agg(F.min("d").alias("d_trace"), F.min_by(trace, F.struct(F.round("d", digits), F.col(trace))).alias("nearest"))
    named = modes(old_traces, [state, trace], action, "p").select(state, F.col(trace).alias("nearest"), F.col("mode").alias("nearest_mode"))
    out = d_marginal.join(near, state).join(named, [state, "nearest"]).join(truth, state, "left")
    return out.select(state, "d_marginal", "d_trace", (F.col("d_marginal") - F.col("d_trace")).alias("c_trace"), "nearest", "nearest_mode", F.coalesce(F.col("nearest_mode") == F.col("truth"), F.lit(False)).alias("mode_is_truth"))


def alpha_per_state(v: DataFrame, state: str, most: float = 5.0, rounds: int = 4, points: int = 41) -> DataFrame:
    """Per state the exponent that brings p closest to q (KL of q to p^alpha / Z, convex in alpha), the divergence left, that at the start, and the share explained.

    v: (state, p, q) as aligned arrays. A grid is laid over a bracket that shrinks: all inside the row, without a shuffle.
    """
    low, high = F.lit(0.0), F.lit(float(most))
    rows = v
    for k in range(rounds):
        step = (high - low) / float(points - 1)
        rows = rows.withColumn(f"_b{k}", _best_alpha(low, step, points))
        low, high = F.greatest(F.col(f"_b{k}") - step, F.lit(0.0)), F.least(F.col(f"_b{k}") + step, F.lit(float(most)))
    best = F.col(f"_b{rounds - 1}")
    left, start = D.jsd(F.col("q"), D.power(F.col("p"), best)), D.jsd(F.col("q"), F.col("p"))
    out = rows.select(state, best.alias("alpha"), left.alias("residual_jsd"), start.alias("baseline_jsd"))
    return out.withColumn("explained", F.when(F.col("baseline_jsd") > D.TINY, 1 - F.col("residual_jsd") / F.col("baseline_jsd")))


def _best_alpha(low: Column, step: Column, points: int) -> Column:
    def scored(k: Column) -> Column:
        alpha = low + step * k
        return F.struct(D.kl(F.col("q"), D.power(F.col("p"), alpha)).alias("loss"), alpha.alias("alpha"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), scored))["alpha"]


def trace_summary(per_trace: DataFrame, state: str, value: str) -> DataFrame:
    """One row: mean and median over the states of a per-state value, and their number; the values themselves stay in the table."""
    median = exact_quantiles(per_trace, value, [0.5])[0]
    return per_trace.agg(F.avg(value).alias("mean"), F.lit(median).cast("double").alias("median"), F.count(value).alias("n"))


def state_summary(p: DataFrame, outcomes: DataFrame, truth: DataFrame, state: str, trace: str, action: str) -> DataFrame:
    """The per-state table: modes, truth metrics, entropies and outcomes. p: (state, trace, action, p); outcomes: (state, trace, outcome)."""
    from . import states as S

    g = S.marginals(p, state, trace, action)
    t = truth_metrics(g, truth, [state], state, action, "g")
    h = S.entropy_table(p, state, trace, action)
    o = outcomes.groupBy(state).agg(F.avg("outcome").alias("mean_outcome"), F.max("outcome").alias("max_outcome"), F.count_if(F.col("outcome") > 0).alias("n_correct"))
    return modes(g, [state], action, "g").join(t, state).join(h, state).join(o, state)


def config_id(compute: str, size: str, alpha: str, beta: str) -> str:
    return f"{compute}_{size}_alpha{alpha}_beta{beta}"


def parsed_config(config: Column) -> Column:
    """(compute, size, alpha, beta) of a configuration's name."""
    part = lambda k, word="": F.replace(F.get(F.split(config, "_"), F.lit(k)), F.lit(word), F.lit("")) if word else F.get(F.split(config, "_"), F.lit(k))
    return F.struct(part(0).alias("compute"), part(1).alias("size"), part(2, "alpha").alias("alpha"), part(3, "beta").alias("beta"))
