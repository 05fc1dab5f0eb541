"""Lookups between relations, ordered picks, and reports over stages of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Later duplicates overwrite: the row with the largest order per key, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(*df.columns)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], default: dict[str, object] | None = None) -> DataFrame:
    """A left join; unmatched rows get the defaults."""
    out = left.join(right, keys, "left")
    return out.fillna(default) if default else out


def matched_and_skipped(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the number of left rows without a partner."""
    return left.join(right, keys), left.join(right.select(*keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("skipped"))


def committed_gap(candidates: DataFrame, committed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The committed move's value minus the best (smallest) candidate's; NULL unless both are known."""
    best = candidates.groupBy(*keys).agg(F.min(value).alias("best"))
    return committed.join(best, keys, "left").withColumn("gap", F.col(value) - F.col("best"))


def replaced_truth(df: DataFrame, group: list[str], answer: str, truth: str, order: str) -> DataFrame:
    """The ground truth replaced by the group's majority answer; the original is kept beside it."""
    from .evaluation import majority

    m = majority(df, group, answer, order).select(*group, "majority")
    return df.join(m, group).withColumn(f"original_{truth}", F.col(truth)).withColumn(truth, F.coalesce("majority", truth)).drop("majority")


def restored_truth(df: DataFrame, truth: str) -> DataFrame:
    return df.withColumn(truth, F.col(f"original_{truth}")).drop(f"original_{truth}")


def zipped(*lists: str) -> Column:
    """Parallel list columns as one list of structs."""
    return F.arrays_zip(*lists)


def block_first(df: DataFrame, block: str, row: str, k: int) -> DataFrame:
    """The first k rows of each block by row."""
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(block).orderBy(row))).filter(F.col("_p") <= k).drop("_p")


def argbest(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Per group the row with the highest score, ties to the highest tie value."""
    rest = [c for c in df.columns if c != group]
    return df.groupBy(group).agg(F.max_by(F.struct(*rest), F.struct(score, tie)).alias("_row")).select(group, "_row.*").select(*df.columns)


def worst_to_best(df: DataFrame, group: str, score: str, text: str, separator: str = " <sep> ") -> DataFrame:
    """Texts of a group joined from the worst to the best score."""
    seq = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(score, text))).alias("_s"))
    return seq.select(group, F.array_join(F.col(f"_s.{text}"), separator).alias(text))


def top_by_max(df: DataFrame, category: str, key: str, severity: str, n: int) -> DataFrame:
    """The n keys of each category with the largest severity anywhere, ranked; the largest severity per key comes first."""
    m = df.groupBy(category, key).agg(F.max(severity).alias(severity))
    place = F.row_number().over(Window.partitionBy(category).orderBy(F.col(severity).desc(), key))
    return m.withColumn("place", place).filter(F.col("place") <= n)


def stage_summary(df: DataFrame, stage: str, category: str, names: list[str], value: str) -> DataFrame:
    """One wide row per stage: counts of a fixed list of categories, zeros filled, and the mean value overall and by category."""
    counts = [F.count_if(F.col(category) == n).alias(f"n_{n}") for n in names]
    means = [F.avg(F.when(F.col(category) == n, F.col(value))).alias(f"mean_{n}") for n in names]
    return df.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *counts, *means)


def bracket_fractions(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Counts and fractions of categories per key."""
    c = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def fit_quantiles(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Median and quartiles by linear interpolation, and the mean."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(stage).agg(q.alias("_q"), F.avg(value).alias("mean")).select(stage, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "mean")


def ordered_union(a: Column, b: Column) -> Column:
    """Two vocabularies in the order first seen."""
    return F.array_union(a, b)


def greedy_bins(sizes: Column, cap: int) -> Column:
    """Bin numbers of a list of sizes in order: a new bin opens when the running size would pass the cap. For lists bounded by what one writer holds."""
    zero = F.struct(F.array().cast("array<int>").alias("bins"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["used"] > 0) & (acc["used"] + x > cap)
        b = acc["bin"] + opens.cast("int")
        return F.struct(F.concat(acc["bins"], F.array(b)).alias("bins"), b.alias("bin"), (F.when(opens, F.lit(0)).otherwise(acc["used"]) + x).cast("long").alias("used"))

    return F.aggregate(sizes, zero, step)["bins"]


def shard_local_windows(df: DataFrame, shard: str, row: str, cap: int, wanted: int) -> DataFrame:
    """``wanted`` rows per shard out of at most its first ``cap``; a short shard starts over."""
    n = df.filter(F.col(row) < cap).groupBy(shard).agg(F.count(F.lit(1)).alias("_n"))
    slots = n.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1)))).withColumn(row, (F.col("slot") % F.col("_n")).cast(dict(df.dtypes)[row]))
    return slots.drop("_n").join(df, [shard, row])


def response_lengths(mask: Column, prompt_mask: Column) -> tuple[Column, Column]:
    total = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x)
    return total(prompt_mask), total(mask)


def throughput(df: DataFrame, tokens: str, seconds: str, devices: int) -> DataFrame:
    """Tokens, tokens per second and device, and milliseconds per token."""
    t, s = F.sum(tokens), F.sum(seconds)
    return df.agg(t.alias("tokens"), (t / (s * devices)).alias("tokens_per_device_second"), (s * 1000 / t).alias("ms_per_token"))


def composite_reward(outcome: Column, step: Column, alpha: float = 0.2) -> Column:
    """(1 - alpha) outcome + alpha step."""
    return (1 - alpha) * outcome + alpha * step


def outcome_distribution(df: DataFrame, group: str, value: str, threshold: float = 300.0) -> DataFrame:
    """Shares of winning, drawn and losing leaves."""
    v = F.col(value)
    return df.groupBy(group).agg(F.avg((v > threshold).cast("double")).alias("win"), F.avg((F.abs(v) <= threshold).cast("double")).alias("draw"), F.avg((v < -threshold).cast("double")).alias("loss"))
