"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Texts are equal when identical after each run of ASCII white space is one space.

Defined results: a null text counts as empty; very long texts are hashed and compared whole; a null doc_id counts as larger than any
other; rows that repeat a doc_id and a text belong to its group, and one of them stays, of ties in normalised text the one
whose text has the smallest hash;
an empty table gives no rows. Extra columns ride along in ``drop_copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, hot_join, with_membership, written

#: A group over this share of all rows is salted when its bytes are compared: at most 1 / share such groups exist.
HEAVY = 1 / 1000
#: Copies of one doc_id and text that are made at once.
COPIES = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def content_groups(docs: DataFrame, hash_fn: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per document: doc_id, group_key (hash, and text only where hashes collide), text_sha256, keep_id, group_size, kept.

    The hash groups rows without their texts. Then the texts of groups of two or more
    meet: the smallest and the largest text of a group are equal if and only if all bytes
    are. Groups that fail are split by their texts.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("t")).select("doc_id", "t", hash_fn(F.col("t")).alias("h"))
    # by (h, doc_id): a hot hash spreads over its doc_ids, repeated rows are one unit
    units = written(rows.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2(F.col("t").cast("binary"), 256)).alias("text_sha256")), "dedup-units")
    groups = written(units.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "dedup-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    clash = written(_collisions(rows, groups, total), "dedup-collisions")
    if not clash.isEmpty():
        return _split(rows, units, groups, clash)
    return _rows(hot_join(units, groups, ["h"], "group_size", total), units)


def _rows(joined: DataFrame, units: DataFrame) -> DataFrame:
    """A row per copy. A unit's copies are dealt in parts of COPIES, so that neither an array nor a task holds all of them."""
    joined = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    if not units.filter(F.col("n") > COPIES).isEmpty():
        joined = joined.repartition("h", "doc_id", "part")
    within = F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("part") * COPIES))
    copies = joined.withColumn("copy", F.explode(within)).withColumn("copy", F.col("part") * COPIES + F.col("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select("doc_id", F.col("h").alias("group_key"), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def _collisions(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Hashes whose texts differ."""
    many = groups.filter("group_size > 1")
    heavy = many.filter(F.col("group_size") > max(1000, int(total * HEAVY))).select("h", F.ceil(F.col("group_size") / 1000).cast("int").alias("salts"))
    rows = with_membership(rows, F.xxhash64("h"), many.select(F.xxhash64("h").alias("k")), "maybe").filter("maybe").drop("maybe")
    rows = rows.join(F.broadcast(heavy), "h", "left")  # at most 1 / HEAVY rows
    rows = rows.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int"))
    salts = F.when(F.col("group_size") > max(1000, int(total * HEAVY)), F.ceil(F.col("group_size") / 1000)).otherwise(1).cast("int")
    many = many.select("h", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = rows.select("h", "salt", "t").join(many, ["h", "salt"], "left_semi")
    ends = met.groupBy("h", "salt").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    ends = ends.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return ends.filter("low <> high").select("h")


def _split(rows: DataFrame, units: DataFrame, groups: DataFrame, clash: DataFrame) -> DataFrame:
    """Groups by hash and text for the hashes in clash, by hash for the rest."""
    clean = units.join(clash, "h", "left_anti").join(groups, "h")
    bad = rows.join(clash, "h", "left_semi").withColumn("text_sha256", F.sha2(F.col("t").cast("binary"), 256))
    bad = bad.groupBy("h", "t", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text_sha256").alias("text_sha256"))
    bad_groups = bad.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    bad = bad.join(bad_groups, ["h", "t"]).withColumn("h", F.concat("h", F.encode("t", "UTF-8")))
    return _rows(clean, units).unionByName(_rows(bad, units))


def report(docs: DataFrame) -> DataFrame:
    return content_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def one_row(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns of one row of each group, one whose text has the smallest hash; groups are combined where they stand, so no task holds one whole."""
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    least = rows.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(held, F.xxhash64("text")).alias("row"))
    return least.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)])


def drop_copies(docs: DataFrame, hash_fn: Callable[[Column], Column] = hash128) -> DataFrame:
    """docs without the rows whose text another row keeps; all columns stay."""
    n = free_names(docs, "_key", "_maybe", "_id", "_sha")
    groups = content_groups(docs, hash_fn).filter("group_size > 1").select(F.col("doc_id").alias(n["_id"]), F.col("text_sha256").alias(n["_sha"]), F.col("kept").alias("stays"))
    groups = written(groups, "dedup-verdicts")
    both = [n["_id"], n["_sha"]]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(n["_key"], F.sha2(normalised(F.col("text")).cast("binary"), 256))
    # texts that surely have no copy pass; the others meet the verdicts on their groups
    rows = with_membership(rows, F.xxhash64(n["_key"]), groups.select(F.xxhash64(n["_sha"]).alias("k")), n["_maybe"])
    alone = rows.filter(~F.col(n["_maybe"])).select(*columns)
    rows = rows.filter(n["_maybe"])
    same = F.col("doc_id").eqNullSafe(F.col(n["_id"])) & (F.col(n["_key"]) == F.col(n["_sha"]))
    goes = groups.groupBy(*both).agg(F.max("stays").alias("stays")).filter("not stays").select(*both)
    rows = rows.join(goes, same, "left_anti")
    return alone.unionByName(one_row(rows, ["doc_id", n["_key"]], docs.columns))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
