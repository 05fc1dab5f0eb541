"""Evaluation metrics: pass@k, best/worst/majority of n, group filters, failure breakdowns, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pass_at_k(n: str | Column, c: str | Column, k: int) -> Column:
    """1 - prod over i < k of (n - c - i) / (n - i); 1 as soon as n - c < k, tested before k is clamped to n."""
    n, c = (F.col(x) if isinstance(x, str) else x for x in (n, c))
    miss = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(k), n.cast("int")) - 1), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i).cast("double"))
    return F.when(n - c < k, 1.0).otherwise(1.0 - miss)


def successes(df: DataFrame, state: list[str], hit: str) -> DataFrame:
    return df.groupBy(*state).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("c"))


def best_of_n(best: bool, n: int, values: str = "vals") -> Column:
    """The expected maximum (minimum) of n draws with replacement from an array: the exact form of the bootstrap mean."""
    v = F.array_sort(values)
    size = F.size(values).cast("double")
    share = lambda i: F.pow((i + 1) / size, F.lit(float(n))) - F.pow(i / size, F.lit(float(n)))
    rank = (lambda i: share(i)) if best else (lambda i: share(size - 1 - i))
    return F.aggregate(F.transform(v, lambda x, i: x * rank(i.cast("double"))), F.lit(0.0), lambda a, x: a + x)


def validation_metrics(df: DataFrame, source: str, prompt: str, value: str, ns: tuple[int, ...] = (2, 4)) -> DataFrame:
    """Per source, the mean over prompts of mean@n, population deviation, and best/worst of n. Responses per prompt are bounded by the sampling plan."""
    per = df.groupBy(source, prompt).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.collect_list(value).alias("vals"))
    cols = [F.avg("mean").alias("mean"), F.avg("std").alias("std")]
    for n in ns:
        cols += [F.avg(best_of_n(True, n)).alias(f"best_{n}"), F.avg(best_of_n(False, n)).alias(f"worst_{n}")]
    return per.groupBy(source).agg(*cols)


def majority(df: DataFrame, keys: list[str], answer: str, order: str) -> DataFrame:
    """The most common answer by key, ties to the one seen first; NULL answers don't vote; ratio is over all rows.

    Two grouped passes: a hot key is combined before the shuffle.
    """
    votes = df.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    rank = F.struct(F.when(F.col(answer).isNull(), F.lit(0)).otherwise(F.col("votes")).alias("v"), (-F.col("first").cast("long")).alias("f"))
    return votes.groupBy(*keys).agg(F.max_by(answer, rank).alias("majority"), F.max(F.when(F.col(answer).isNotNull(), F.col("votes"))).alias("votes"), F.sum("votes").alias("n"))


def group_filter(df: DataFrame, group: str, reward: str, high: float = 1.0) -> DataFrame:
    """Per group its mean reward and whether it is useful (0 < mean < high), too easy or too hard."""
    g = df.groupBy(group).agg(F.avg(reward).alias("mean_reward"))
    verdict = F.when(F.col("mean_reward") <= 0, "too_hard").when(F.col("mean_reward") >= high, "too_easy").otherwise("useful")
    return g.withColumn("verdict", verdict)


def solve_ratios(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Shares of the groups whose rewards are all 0 and all 1."""
    g = df.groupBy(group).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    return g.agg(F.avg(((F.col("lo") == 0) & (F.col("hi") == 0)).cast("double")).alias("solve_none"), F.avg(((F.col("lo") == 1) & (F.col("hi") == 1)).cast("double")).alias("solve_all"))


def mean_sem(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and standard error (sample) by key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def composite_z(df: DataFrame, columns: list[str], out: str = "composite") -> DataFrame:
    """Mean of the columns' population z-scores over the whole table; a column without spread counts 0. Moments are one row."""
    m = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    df = df.crossJoin(F.broadcast(m))
    z = [F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns]
    return df.withColumn(out, sum(z[1:], z[0]) / len(z)).drop(*m.columns)


def agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str, least: int = 10) -> DataFrame:
    """Of two metric tables joined on keys: mean and largest absolute difference and Pearson's r; no row with fewer than ``least`` pairs. Infinite values don't count."""
    clean = lambda d, n: d.select(*keys, F.when(F.col(value).isin(float("inf"), float("-inf")) | F.isnan(value), None).otherwise(F.col(value)).alias(n))
    both = clean(left, "a").join(clean(right, "b"), keys).dropna(subset=["a", "b"])
    diff = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_abs_diff"), F.max(diff).alias("max_abs_diff"), F.corr("a", "b").alias("pearson")).filter(F.col("n") >= least)


def accuracy(df: DataFrame, predicted: str | Column, truth: str | Column, by: list[str]) -> DataFrame:
    hit = (predicted if isinstance(predicted, Column) else F.col(predicted)) == (truth if isinstance(truth, Column) else F.col(truth))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def norm_rank(df: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """Rank by score descending and (rank - 1) / max(n - 1, 1)."""
    w = Window.partitionBy(group)
    r = F.row_number().over(w.orderBy(F.col(score).desc(), order))
    return df.withColumn("rank", r).withColumn("norm_rank", (F.col("rank") - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)).cast("double"))


def explained_variance(df: DataFrame, value: str, target: str) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(target) - F.col(value)) / F.var_samp(target)).alias("explained_variance"))


def masked_stats(df: DataFrame, columns: list[str], mask: str, by: list[str] | None = None) -> DataFrame:
    """Mean, largest and smallest of each column over the valid rows; one pass."""
    valid = lambda c: F.when(F.col(mask) > 0, F.col(c))
    return df.groupBy(*(by or [])).agg(*[f(valid(c)).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def length_stats(df: DataFrame, length: str, most: int, by: list[str] | None = None) -> DataFrame:
    """Mean, largest and smallest length, and the share that was cut at ``most``."""
    return df.groupBy(*(by or [])).agg(F.avg(length).alias("mean"), F.max(length).alias("max"), F.min(length).alias("min"), F.avg((F.col(length) >= most).cast("double")).alias("clip_ratio"))


def label_metrics(df: DataFrame, prompt: str, majority: str, truth: str, majority_reward: str, truth_reward: str) -> DataFrame:
    """Over prompts: whether the majority is the truth, how often both rewards agree, mean rewards, and whether any response is right."""
    per = df.groupBy(prompt).agg(
        F.max((F.col(majority) == F.col(truth)).cast("double")).alias("label_accuracy"), F.avg((F.col(majority_reward) == F.col(truth_reward)).cast("double")).alias("reward_accuracy"),
        F.avg(majority_reward).alias("majority_reward"), F.avg(truth_reward).alias("truth_reward"), F.max((F.col(truth_reward) > 0).cast("double")).alias("pass_at_n"),
    )
    return per.agg(*[F.avg(c).alias(c) for c in per.columns[1:]])
