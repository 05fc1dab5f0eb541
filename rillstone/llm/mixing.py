"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Every source gets a target number of words and a weight schedule over training time
0 to 1. The schedule's integral is the source's cumulative demand; inverting it turns
a document's cumulative words into its training position. Documents are then
range-sorted by position.

Defined results: null or empty texts have size 0 and are never drawn; very long texts are counted whole; a null source is
a source of its own, the last; rows that repeat are documents of their own; an empty
table gives an empty mix; ties are ordered by the hash of doc_id, doc_id, then size. Extra columns ride along in ``mix``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BUCKET_ROWS, WORD, buckets_for, free_names, running_sum, unit_hash, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The schedule of each weight: points in training time, and the weight there, linear in between.
TIMES = (0.0, 0.5, 1.0)
SCHEDULES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))

#: Rows of a bucket whose rows carry texts.
CARRIED_ROWS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source, from rows (no_source, source_key, size): weights share ``share`` times all words;
    no target passes ``most`` times its source's words, and the excess goes to the others by weight.

    Handing the excess on until none is above has one fixed point: the smaller of the cap and
    level x weight. Sources in the order of cap / weight fill up first, so running sums give the level.
    One row a source: the windows without a key run over sources, never over documents.
    """
    by = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("no_source", "source_key")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("rank", rank).withColumn("cycle", (F.col("rank") % len(weights)).cast("int")).withColumn("weight", w)
    by = by.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    order, every = Window.orderBy("fill", "rank"), Window.partitionBy()
    by = by.withColumn("place", F.row_number().over(order))
    by = by.withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(every)
    by = by.withColumn("first", first)
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("weight")))
    return by.select("no_source", "source_key", "source_size", "cycle", target.alias("target"))


def position_at(share: Column, cycle: Column, times: Sequence[float] = TIMES, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The training time at which a source of this schedule has used up ``share`` of its demand (the inverse of the integral)."""

    def inverse(weights: Sequence[float]) -> Column:
        parts = [(t1 - t0) * (w0 + w1) / 2 for t0, t1, w0, w1 in zip(times, times[1:], weights, weights[1:], strict=False)]
        total, done, out = sum(parts), 0.0, F.lit(float(times[-1]))
        if total <= 0:
            raise ValueError("a schedule needs some weight")
        cuts = []
        for k, part in enumerate(parts):
            w0, w1, dt = weights[k], weights[k + 1], times[k + 1] - times[k]
            rest = F.greatest(share * total - done, F.lit(0.0))
            below = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(float(w0 * w0)) + 2 * (w1 - w0) / dt * rest, F.lit(0.0)))
            x = F.when(below > 0, 2 * rest / below).otherwise(0.0)
            done += part
            cuts.append((share * total < done, F.lit(float(times[k])) + F.least(x, F.lit(float(dt)))))
        for test, x in reversed(cuts):
            out = F.when(test, x).otherwise(out)
        return out

    out = inverse(schedules[-1])
    for k in range(len(schedules) - 1):
        out = F.when(cycle % len(schedules) == k, inverse(schedules[k])).otherwise(out)
    return out


def assign_positions(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    times: Sequence[float] = TIMES, schedules: Sequence[Sequence[float]] = SCHEDULES, split_last: bool = True, carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and draws, an array of (epoch, position, words).

    A document is drawn once for each time its source's words pass it before the target is
    reached. The draw at the target is cut there (split_last), or else taken whole if at least half
    of it lies before. carry: all of docs' columns ride along as the struct ``doc``.
    Only doc_id, source and size are shuffled, unless carry is set.
    """
    size, source = word_count(F.col("text")), F.coalesce("source", F.lit(""))
    rows = docs.select("doc_id", F.col("source").isNull().cast("int").alias("no_source"), source.alias("source_key"), size.alias("size"), unit_hash(F.col("doc_id")).alias("h"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []))
    if carry:  # sizes once for the totals, without texts; the texts pass through one shuffle
        narrow = written(rows.drop("doc"), "mix-sizes")
    else:
        rows = narrow = written(rows, "mix-sizes")
    targets = written(source_targets(narrow, weights, share, most), "mix-targets")
    groups, buckets = ["no_source", "source_key"], buckets_for(narrow.count(), CARRIED_ROWS if carry else BUCKET_ROWS)
    if carry:
        rows = _with_offsets(rows, narrow, groups, buckets)
    else:
        rows = running_sum(rows, groups, "h", ["doc_id", "size"], "size", "before", buckets)
    rows = rows.join(targets, groups)
    limit, draws = F.floor("target"), []
    for epoch in range(math.ceil(most)):
        start = F.col("before") + F.lit(epoch).cast("long") * F.col("source_size")
        if split_last:
            words = F.greatest(F.least(limit - start, F.col("size")), F.lit(0))
        else:
            words = F.when(2 * (limit - start) >= F.col("size"), F.col("size")).otherwise(0)
        at = position_at(start / F.col("target"), F.col("cycle"), times, schedules)
        draws.append(F.when(words > 0, F.struct(F.lit(epoch).alias("epoch"), at.alias("position"), words.cast("long").alias("words"))))
    rows = rows.withColumn("draws", F.array_compact(F.array(*draws)))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws", *(["doc"] if carry else []))


def _with_offsets(rows: DataFrame, narrow: DataFrame, groups: list[str], buckets: int) -> DataFrame:
    """running_sum for rows that carry texts: bucket offsets come from the narrow table."""
    at = F.floor(F.col("h") * buckets / float(2**32)).cast("int")
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = narrow.withColumn("_bucket", at).groupBy(*groups, "_bucket").agg(F.sum("size").alias("_sum"))
    offsets = written(totals.select(*groups, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")), "mix-offsets")
    inside = Window.partitionBy(*groups, "_bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bucket", at).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(offsets, [*groups, "_bucket"]).withColumn("before", F.col("_offset") + F.col("_inside"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: docs' columns plus training_position and epoch, one row per draw, range-sorted by position.

    Documents are drawn whole here. Where docs has a column of one of these names, the added one gets an underscore at its end.
    """
    rows = assign_positions(docs, **({"split_last": False} | options), carry=True)
    own = free_names(docs, "training_position", "epoch")
    rows = rows.select("doc", F.explode("draws").alias("draw"))
    rows = rows.orderBy(F.col("draw.position"), F.col("doc.doc_id"), F.col("draw.epoch"))
    return rows.select("doc.*", F.col("draw.position").alias(own["training_position"]), F.col("draw.epoch").alias(own["epoch"]))


def curriculum(docs: DataFrame) -> DataFrame:
    """The documents' digest in training order; documents that are not drawn come last."""
    rows = assign_positions(docs)
    first = F.try_element_at("draws", F.lit(1))["position"]
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), F.size("draws").cast("int").alias("n_draws"))
    return rows.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(source IS NULL AS INTEGER) AS no_source, coalesce(source, '') AS source_key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY no_source, source_key) - 1 AS rank
  FROM d GROUP BY 1, 2),
w AS (
  SELECT *, rank % 3 AS cycle, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][rank % 3 + 1] AS weight, 2::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
p AS (
  SELECT *, row_number() OVER (ORDER BY fill, rank) AS place,
    coalesce(sum(cap) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS full_,
    sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
    sum(source_size) OVER () AS whole
  FROM f),
l AS (SELECT *, (1.5::DOUBLE * whole - full_) / open_ AS level FROM p),
g AS (SELECT min(place) AS place, min_by(level, place) AS level FROM l WHERE level <= fill),
t AS (
  SELECT l.no_source, l.source_key, l.source_size, l.cycle,
    CASE WHEN l.place < g.place THEN l.cap ELSE least(l.cap, g.level * l.weight) END AS target
  FROM l, g),
c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY h, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d),
x AS (
  SELECT doc_id, size, source_size, target, cycle,
    CAST(greatest(least(floor(target) - before, size), 0) AS BIGINT) AS w0,
    CAST(greatest(least(floor(target) - before - source_size, size), 0) AS BIGINT) AS w1,
    CASE WHEN greatest(least(floor(target) - before, size), 0) > 0 THEN before / target END AS y
  FROM c JOIN t USING (no_source, source_key))
SELECT doc_id, size, source_size, target, w0 + w1 AS taken,
  CASE WHEN y IS NULL THEN NULL WHEN cycle = 0 THEN CASE WHEN y * 1.0::DOUBLE < 0.375 THEN 0::DOUBLE + least(2 * greatest(y * 1.0::DOUBLE - 0::DOUBLE, 0::DOUBLE) / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2::DOUBLE * greatest(y * 1.0::DOUBLE - 0::DOUBLE, 0::DOUBLE), 0::DOUBLE))), 0.5::DOUBLE)
      ELSE 0.5::DOUBLE + least(2 * greatest(y * 1.0::DOUBLE - 0.375::DOUBLE, 0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 2::DOUBLE * greatest(y * 1.0::DOUBLE - 0.375::DOUBLE, 0::DOUBLE), 0::DOUBLE))), 0.5::DOUBLE) END
    WHEN cycle = 1 THEN y
    ELSE CASE WHEN y * 1.0::DOUBLE < 0.625 THEN 0::DOUBLE + least(2 * greatest(y * 1.0::DOUBLE - 0::DOUBLE, 0::DOUBLE) / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2::DOUBLE * greatest(y * 1.0::DOUBLE - 0::DOUBLE, 0::DOUBLE), 0::DOUBLE))), 0.5::DOUBLE)
      ELSE 0.5::DOUBLE + least(2 * greatest(y * 1.0::DOUBLE - 0.625::DOUBLE, 0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE - 2::DOUBLE * greatest(y * 1.0::DOUBLE - 0.625::DOUBLE, 0::DOUBLE), 0::DOUBLE))), 0.5::DOUBLE) END
  END AS first_position,
  CAST(w0 > 0 AS INTEGER) + CAST(w1 > 0 AS INTEGER) AS n_draws
FROM x
"""
