"""Seeded sampling: temperature sampling, bootstrap, log-normal widths; and the covariance rules that pick tokens.

Randomness is the MD5 of a seed and keys, so a lost task draws the same again, and any engine can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import exact_quantiles


def hashed(seed: int, *keys: str | Column) -> Column:
    """A whole number below 2^48 that depends on the seed and the keys alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in (0, 1) that depends on the seed and the keys alone."""
    return (hashed(seed, *keys).cast("double") + 0.5) / float(16**12)


def gumbel_sample(df: DataFrame, group: str, action: str, score: str, n: int = 1, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """n actions per group without replacement, in proportion to exp(score / temperature): the largest perturbed scores."""
    noise = -F.ln(-F.ln(uniform(seed, group, action)))
    rows = df.withColumn("_g", F.col(score) / temperature + noise)
    return rows.withColumn("draw", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_g"), action))).filter(F.col("draw") <= n).drop("_g")


def bootstrap(values: Column, size: int, reps: int, seed: int, key: Column, reducer: str = "max") -> tuple[Column, Column]:
    """Mean and population deviation over ``reps`` resamples with replacement of a bounded list: the seeded counterpart of the exact form."""
    pick = lambda r, i: F.get(values, F.floor(uniform(seed, key, r, i) * F.size(values)).cast("int"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: pick(r, i)))
    stat = F.transform(draws, (lambda d: F.array_max(d)) if reducer == "max" else (lambda d: F.array_min(d)))
    mean = F.aggregate(stat, F.lit(0.0), lambda a, x: a + x) / reps
    square = F.aggregate(stat, F.lit(0.0), lambda a, x: a + x * x) / reps
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def lognormal_width(seed: int, keys: list[str], mean: float, sigma: float, least: int, most: int) -> Column:
    """A whole number, log-normal with the given mean, clipped."""
    normal = F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))
    x = F.exp(F.lit(math.log(mean) - sigma * sigma / 2) + normal * sigma)
    return F.least(F.greatest(F.round(x), F.lit(least)), F.lit(most)).cast("int")


def token_covariance(df: DataFrame, log_prob: str, advantage: str, out: str = "cov") -> DataFrame:
    """Each token's part of the covariance of log probability and advantage; the two means are one row."""
    m = df.agg(F.avg(log_prob).alias("_ml"), F.avg(advantage).alias("_ma"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, (F.col(log_prob) - F.col("_ml")) * (F.col(advantage) - F.col("_ma"))).drop("_ml", "_ma")


def clip_by_covariance(df: DataFrame, cov: str, low: float, high: float, ratio: float, seed: int, *keys: str) -> DataFrame:
    """``keep`` is 0 for a random share of the tokens whose covariance lies inside (low, high)."""
    inside = (F.col(cov) > low) & (F.col(cov) < high)
    return df.withColumn("keep", F.when(inside & (uniform(seed, *keys) < ratio), 0).otherwise(1))


def penalised_by_covariance(df: DataFrame, cov: str, ratio: float) -> DataFrame:
    """``penalised`` is 1 for the tokens whose covariance is in the top share; the border is an exact quantile."""
    border = exact_quantiles(df, cov, [1 - ratio])[0]
    return df.withColumn("penalised", (F.col(cov) > F.lit(border)).cast("int"))
