"""Group-relative advantages, returns and losses of reinforcement learning, as window and array plans.

Rows are rollouts (one per response) or tokens (one per position). Groups are the
rollouts of one prompt, a handful of rows, so windows by group stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import Registry
from .scans import reverse_scan

ESTIMATORS: Registry[Callable[..., DataFrame]] = Registry("advantage estimator")


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@ESTIMATORS.register("grpo")
def group_relative(df: DataFrame, group: str, score: str, out: str = "advantage", scale: bool = True, eps: float = 1e-6) -> DataFrame:
    """(score - group mean) / (sample deviation + eps); a group of one has mean 0 and deviation 1."""
    w = Window.partitionBy(group)
    one = F.count(F.lit(1)).over(w) == 1
    mean = F.when(one, 0.0).otherwise(F.avg(score).over(w))
    if not scale:
        return df.withColumn(out, F.col(score) - mean)
    sd = F.when(one, 1.0).otherwise(F.stddev_samp(score).over(w))
    return df.withColumn(out, (F.col(score) - mean) / (sd + F.lit(eps)))


@ESTIMATORS.register("rloo")
def leave_one_out(df: DataFrame, group: str, score: str, out: str = "advantage") -> DataFrame:
    """score * n / (n - 1) - mean * n / (n - 1); unchanged in a group of one."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w).cast("double")
    return df.withColumn(out, F.when(n > 1, (F.col(score) - F.avg(score).over(w)) * n / F.nullif(n - 1, F.lit(0.0))).otherwise(F.col(score)))


@ESTIMATORS.register("opo")
def length_weighted(df: DataFrame, group: str, score: str, length: str, out: str = "advantage") -> DataFrame:
    """Centred by the group's mean weighted by response length; a group of one keeps its score."""
    w = Window.partitionBy(group)
    base = F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w)
    return df.withColumn(out, F.col(score) - F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(base))


@ESTIMATORS.register("grpo_passk")
def best_minus_second(df: DataFrame, group: str, score: str, order: str, out: str = "advantage", scale: bool = True, eps: float = 1e-6) -> DataFrame:
    """Only the best row of a group gets (best - second) / (sample deviation + eps). Groups need two rows; ties go to ``order``."""
    w = Window.partitionBy(group)
    ranked = w.orderBy(F.col(score).desc(), order)
    top, second = F.max(score).over(w), F.max(F.when(F.col("_place") == 2, F.col(score))).over(w)
    gain = (top - second) / (F.stddev_samp(score).over(w) + eps) if scale else top - second
    df = df.withColumn("_place", F.row_number().over(ranked))
    return df.withColumn(out, F.when(F.col("_place") == 1, gain).otherwise(0.0)).drop("_place")


@ESTIMATORS.register("reinforce_plus_plus_baseline")
def centred_then_whitened(df: DataFrame, group: str, score: str, mask: str | None = None, out: str = "advantage", eps: float = 1e-8) -> DataFrame:
    """Centred by the group mean, then whitened over all valid rows; the global moments are one aggregate row."""
    df = group_relative(df, group, score, "_centred", scale=False)
    return masked_whiten(df, "_centred", mask, out, eps=eps).drop("_centred")


@ESTIMATORS.register("self_distillation")
def outcome_over_mean(df: DataFrame, group: str, score: str, sign: int = 1, out: str = "advantage") -> DataFrame:
    """Plus or minus the group mean as advantage."""
    return df.withColumn(out, F.lit(float(sign)) * F.avg(score).over(Window.partitionBy(group)))


@ESTIMATORS.register("positive_only")
def positive_only(df: DataFrame, score: str, out: str = "advantage") -> DataFrame:
    return df.withColumn(out, F.when(F.col(score) != 0, F.col(score)).otherwise(0.0).cast("double"))


@ESTIMATORS.register("negative_only")
def negative_only(df: DataFrame, score: str, out: str = "advantage") -> DataFrame:
    return df.withColumn(out, F.when(F.col(score) != 1, F.col(score) - 1).otherwise(0.0).cast("double"))


def masked_whiten(df: DataFrame, value: str, mask: str | None = None, out: str = "whitened", shift_mean: bool = True, eps: float = 1e-8) -> DataFrame:
    """(value - mean) / sqrt(variance + eps) with Bessel's correction over the rows where mask is set."""
    seen = df.filter(F.col(mask) > 0) if mask else df
    moments = seen.agg(F.avg(value).alias("_mean"), F.var_samp(value).alias("_var"))
    df = df.crossJoin(F.broadcast(moments))  # one row
    white = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + eps)
    return df.withColumn(out, white if shift_mean else white + F.col("_mean")).drop("_mean", "_var")


def sequence(df: DataFrame, key: str | list[str], order: str, *columns: str, name: str = "steps") -> DataFrame:
    """One row per sequence: an array of structs in order. A sequence is bounded by the response length."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))


@ESTIMATORS.register("reinforce_plus_plus")
def discounted_returns(df: DataFrame, key: str, order: str, reward: str, gamma: float = 1.0, out: str = "returns", baseline: str | None = None, mask: str | None = None, whiten: bool = False) -> DataFrame:
    """Reverse cumulative discounted reward per sequence, of any length, minus the baseline if there is one.

    With a mask, what follows a masked token doesn't reach the tokens before it; with ``whiten`` the column ``advantage`` holds the returns
    whitened over the valid tokens, 0 elsewhere.
    """
    rows = df.select(key, order, reward, *[c for c in (baseline, mask) if c])
    rows = reverse_scan(rows, key, order, F.col(reward), gamma, "_value_ahead", open_=F.col(mask) > 0 if mask else None)
    rows = rows.withColumn(out, F.col("_value_ahead") - (F.col(baseline) if baseline else 0.0))
    if not whiten:
        return rows.select(key, order, out)
    rows = masked_whiten(rows, out, mask, "advantage")
    return rows.select(key, order, out, (F.when(F.col(mask) > 0, F.col("advantage")).otherwise(0.0) if mask else F.col("advantage")).alias("advantage"))


@ESTIMATORS.register("gae")
def gae(df: DataFrame, key: str, order: str, reward: str, value: str, gamma: float = 1.0, lam: float = 1.0, mask: str | None = None, whiten: bool = False) -> DataFrame:
    """Generalised advantage estimation backwards over each sequence, of any length; returns = advantage + value, before any whitening over the valid tokens."""
    rows = df.select(key, order, reward, value, *([mask] if mask else []))
    rows = reverse_scan(rows, key, order, F.col(reward) - F.col(value), gamma * lam, "_advantage", follow=F.col(value), ahead=gamma)
    rows = rows.withColumn("returns", F.col("_advantage") + F.col(value))
    if whiten:
        rows = masked_whiten(rows, "_advantage", mask, "advantage")
    else:
        rows = rows.withColumnRenamed("_advantage", "advantage")
    return rows.select(key, order, "advantage", "returns")


def stepwise(df: DataFrame, group: str, step: str, score: str, out: str = "advantage", eps: float = 1e-6) -> DataFrame:
    """The k-th step normalised across the rollouts of its group."""
    w = Window.partitionBy(group, step)
    one = F.count(F.lit(1)).over(w) == 1
    mean, sd = F.when(one, 0.0).otherwise(F.avg(score).over(w)), F.when(one, 1.0).otherwise(F.stddev_samp(score).over(w))
    return df.withColumn(out, (F.col(score) - mean) / (sd + eps))


@ESTIMATORS.register("step_wise_grpo_tokens")
def positionwise(df: DataFrame, group: str, position: str, reward: str, mask: str, out: str = "advantage", scale: bool = True, eps: float = 1e-6) -> DataFrame:
    """Each token position normalised across a group's sequences, over valid tokens only; invalid tokens get 0, a lone one its reward."""
    w = Window.partitionBy(group, position)
    valid = F.when(F.col(mask) > 0, F.col(reward).cast("double"))
    lone = F.count(valid).over(w) <= 1
    mean, sd = F.when(lone, 0.0).otherwise(F.avg(valid).over(w)), F.when(lone, 1.0).otherwise(F.stddev_samp(valid).over(w))
    centred = valid - mean
    return df.withColumn(out, F.coalesce(centred / (sd + eps) if scale else centred, F.lit(0.0)))


@ESTIMATORS.register("tango_grpo")
def outcome_and_steps(df: DataFrame, group: str, key: str, position: str, outcome: str, step_reward: str, mask: str, alpha: float = 0.2, eps: float = 1e-6, differential: str | None = None) -> DataFrame:
    """(1 - alpha) of the group-relative outcome and alpha of the normalised step rewards, each step reaching the tokens before it (reverse running sum).

    ``differential``: steps whose sign disagrees with the outcome's are dropped ("zero") or halved ("half").
    outcome: one value a sequence, on each of its tokens.
    """
    if differential not in (None, "zero", "half"):
        raise ValueError(f"unknown mode {differential!r}")
    one = df.groupBy(group, key).agg(F.first(outcome).alias("_outcome"))
    one = group_relative(one, group, "_outcome", "_relative", eps=eps).select(group, key, "_relative")
    rows = positionwise(df, group, position, step_reward, mask, "_step", eps=eps).join(one, [group, key])
    if differential:
        agrees = F.col("_step") * F.col("_relative") >= 0
        rows = rows.withColumn("_step", F.when(agrees, F.col("_step")).otherwise(F.col("_step") * (0.0 if differential == "zero" else 0.5)))
    later = Window.partitionBy(key).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    both = (1 - alpha) * F.col("_relative") + alpha * F.sum("_step").over(later)
    return rows.withColumn("advantage", F.when(F.col(mask) > 0, both).otherwise(0.0)).drop("_step", "_relative")


def kl_penalty(p: str | Column, q: str | Column, kind: str = "kl") -> Column:
    """Per-token estimators of KL(p || q) from log probabilities."""
    d = _col(p) - _col(q)
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        r = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(r) - r - 1, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(f"unknown kind {kind}")


def clipped_objective(adv: str | Column, log_ratio: str | Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> tuple[Column, Column]:
    """(per-token loss, whether it was clipped): the clipped ratio objective with a dual clip for negative advantages."""
    a = _col(adv)
    r = F.exp(F.least(F.greatest(_col(log_ratio), F.lit(-20.0)), F.lit(20.0)))
    plain, cut = -a * r, -a * F.least(F.greatest(r, F.lit(1 - low)), F.lit(1 + high))
    upper = F.greatest(plain, cut)
    return F.when(a < 0, F.least(-a * dual, upper)).otherwise(upper), cut > plain


def value_loss(value: Column, old: Column, target: Column, clip: float = 0.5) -> tuple[Column, Column]:
    cut = F.least(F.greatest(value, old - clip), old + clip)
    a, b = (value - target) ** 2, (cut - target) ** 2
    return 0.5 * F.greatest(a, b), b > a


#: Losses by name: (advantage, log ratio) -> (loss per token, whether it was clipped).
LOSSES: Registry = Registry("loss")
LOSSES.register("vanilla", clipped_objective)


def aggregate_loss(df: DataFrame, key: str, loss: str, mask: str, horizon: float | None = None) -> DataFrame:
    """One row with the four ways to aggregate token losses."""
    seq = df.groupBy(key).agg(F.sum(F.col(loss) * F.col(mask)).alias("total"), F.sum(mask).alias("tokens"))
    long = F.lit(float(horizon)) if horizon else F.max("tokens")
    return seq.agg(
        (F.sum("total") / F.sum("tokens")).alias("token_mean"),
        F.avg("total").alias("seq_mean_token_sum"),
        F.avg(F.col("total") / F.nullif("tokens", F.lit(0))).alias("seq_mean_token_mean"),
        (F.sum("total") / long).alias("seq_mean_token_sum_norm"),
    )


def reward_with_kl(df: DataFrame, reward: str, p: str, q: str, beta: float, kind: str = "kl", out: str = "token_reward") -> DataFrame:
    """Adds ``kl`` and the reward less ``beta`` times it, token by token."""
    return df.withColumn("kl", kl_penalty(p, q, kind)).withColumn(out, F.col(reward) - F.lit(float(beta)) * F.col("kl"))


def next_kl_weight(beta: float, current: float, target: float, steps: int, horizon: float) -> float:
    """Proportional controller of the KL weight, its error clipped to 0.2."""
    error = min(max(current / target - 1, -0.2), 0.2)
    return beta * (1 + error * steps / horizon)
