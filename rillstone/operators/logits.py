"""Entropy and self-certainty of logits that come in chunks of the vocabulary, as mergeable sums.

A chunk becomes four numbers beside an anchor near its largest logit: the sum of exp(x - anchor), the same weighted with x - anchor, the plain sum and the
number. Anchors are multiples of a step, so chunks with one anchor are added up on the map side, and what is left of a position is a few rows,
which are brought to its highest anchor. Neither a vocabulary nor a position meets in one row or one buffer, and no exponential overflows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import total

STEP = 64.0


def chunked_entropies(chunks: DataFrame, keys: list[str], logits: str, entropy: str = "entropy", certainty: str = "self_certainty") -> DataFrame:
    """(keys, entropy, self_certainty) over all chunks of a position, in any order and of any length; logits: an array of double.

    entropy is logsumexp - sum p x, certainty logsumexp - mean, in nats. Null logits don't count. A logit of -inf has no share, which makes the certainty
    infinite; NaN and inf make both NaN. Without a logit above -inf both are null. Null keys are a position of their own.
    """
    x = F.filter(logits, lambda v: v.isNotNull())
    rows = chunks.select(*keys, x.alias("_x")).filter(F.size("_x") > 0)
    top = F.array_max("_x")
    rows = rows.withColumn("_anchor", F.when(top == float("-inf"), F.lit(None)).otherwise(F.rint(top / STEP)))
    shifted = F.transform(F.filter("_x", lambda v: v != float("-inf")), lambda v: v - F.col("_anchor") * STEP)
    rows = rows.withColumn("_d", shifted)
    parts = rows.select(
        *keys, "_anchor", F.when(F.col("_anchor").isNotNull(), total(F.transform("_d", F.exp))).alias("_z"),
        F.when(F.col("_anchor").isNotNull(), total(F.transform("_d", lambda v: F.exp(v) * v))).alias("_m"), total(F.col("_x")).alias("_sum"), F.size("_x").cast("long").alias("_n"),
    )
    few = parts.groupBy(*keys, "_anchor").agg(*[F.sum(c).alias(c) for c in ("_z", "_m", "_sum", "_n")])
    few = few.withColumn("_top", F.max("_anchor").over(Window.partitionBy(*keys)))
    down = (F.col("_anchor") - F.col("_top")) * STEP
    few = few.withColumn("_down", down).withColumn("_scale", F.exp("_down"))
    shift = F.when(F.col("_scale") > 0, F.col("_scale") * (F.col("_m") + F.col("_down") * F.col("_z"))).when(F.isnan("_scale"), F.lit(float("nan"))).otherwise(0.0)
    whole = few.groupBy(*keys).agg(F.max("_top").alias("_top"), F.sum(F.col("_scale") * F.col("_z")).alias("_z"), F.sum(shift).alias("_m"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    log_z = F.ln("_z")
    return whole.select(*keys, (log_z - F.col("_m") / F.col("_z")).alias(entropy), (log_z + F.col("_top") * STEP - F.col("_sum") / F.col("_n")).alias(certainty))


def in_chunks(df: DataFrame, keys: list[str], values: str, size: int) -> DataFrame:
    """(keys, chunk, values): an array in pieces of at most ``size``; an empty or null one has no piece."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.struct(k.alias("chunk"), F.slice(values, k * size + 1, F.lit(size)).alias(values)))
    return df.filter(F.size(values) > 0).select(*keys, F.explode(pieces).alias("_p")).select(*keys, "_p.chunk", f"_p.{values}")
