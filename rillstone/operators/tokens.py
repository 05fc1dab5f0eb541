"""Vocabularies, encoding, masks, padding and fixed-length packing over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

IGNORED = -100


def vocabulary(df: DataFrame, text: str, specials: tuple[str, ...] = ("<pad>", "<unk>")) -> DataFrame:
    """(token, id): specials first, then the distinct words in code point order.

    Distinct words are range-partitioned and numbered from per-range counts; the counts are one row a range.
    """
    words = df.select(F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("token")).distinct()
    ranged = written(words.repartitionByRange("token").withColumn("_part", F.spark_partition_id()), "vocabulary")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranged.join(F.broadcast(before.select("_part", "_before")), "_part")
    ranked = ranked.select("token", (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("token")) - 1 + len(specials)).cast("long").alias("id"))
    fixed = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id long")
    return fixed.unionByName(ranked)


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """(key, ids): words looked up by a join, unknown ones replaced, in order."""
    words = df.select(key, F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("pos", "token"))
    found = words.join(vocab, "token", "left").select(key, "pos", F.coalesce("id", F.lit(unknown)).alias("id"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def pad(ids: Column, length: int, value: int = 0, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def truncate(ids: Column, length: int, side: str = "right") -> Column:
    n = F.size(ids)
    if side == "right":
        return F.slice(ids, 1, length)
    if side == "left":
        return F.slice(ids, F.greatest(n - length + 1, F.lit(1)), F.lit(length))
    if side == "middle":
        head = length // 2
        return F.when(n <= length, ids).otherwise(F.concat(F.slice(ids, 1, head), F.slice(ids, F.greatest(n - (length - head) + 1, F.lit(1)), F.lit(length - head))))
    raise ValueError(f"unknown side {side}")


def strip_pads(ids: Column, value: int = 0) -> Column:
    return F.filter(ids, lambda x: x != value)


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to and including the first end token."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def attention_mask(ids: Column, value: int = 0) -> Column:
    return F.transform(ids, lambda x: (x != value).cast("int"))


def positions(mask: Column) -> Column:
    """Position ids that count real tokens only."""
    n = F.aggregate(mask, F.array().cast("array<int>"), lambda a, m: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + m)))
    return F.transform(n, lambda x: F.greatest(x - 1, F.lit(0)))


def fixed_windows(df: DataFrame, stream: str, order: str, token: str, length: int) -> DataFrame:
    """Per stream, the (n - 1) // length windows x of a token sequence and y, the same shifted by one.

    df has one row a token; a window is gathered by its number, never the stream.
    """
    rows = df.select(stream, F.col(order).alias("pos"), F.col(token).alias("tok"))
    n = rows.groupBy(stream).agg(F.count(F.lit(1)).alias("n"))
    # the token at a window's border is the last target of one window and the first input of the next
    rows = rows.withColumn("w", F.array((F.col("pos") / length).cast("long"), ((F.col("pos") - 1) / length).cast("long")))
    rows = rows.select(stream, "pos", "tok", F.explode(F.array_distinct(F.filter("w", lambda x: x >= 0))).alias("window")).filter("pos >= 0")
    seq = rows.groupBy(stream, "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("t"))
    seq = seq.join(n, stream).filter(F.col("window") < F.floor((F.col("n") - 1) / length))
    return seq.select(stream, "window", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))


def sft_rows(prompt: Column, response: Column, seq_len: int, eos: int, strip_eos: bool = False) -> tuple[Column, Column]:
    """(inputs, labels): prompt without its last id, then the response without its first, cut, shifted by one; prompt labels ignored."""
    body = F.concat(F.slice(prompt, 1, F.greatest(F.size(prompt) - 1, F.lit(0))), F.slice(response, 2, F.greatest(F.size(response) - 1, F.lit(0))))
    body = F.filter(body, lambda x: x != eos) if strip_eos else body
    body = F.slice(body, 1, seq_len + 1)
    n = F.size(body)
    labels = F.slice(F.transform(body, lambda x, i: F.when(i < F.size(prompt) - 1, IGNORED).otherwise(x)), F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.slice(body, F.lit(1), F.greatest(n - 1, F.lit(0))), labels


def assistant_mask(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation its tokens in order and a mask that is 1 on the assistant's words only."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = df.select(conv, turn, words.alias("w"), (F.col(role) == "assistant").cast("int").alias("m"))
    seq = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "w", "m"))).alias("s"))
    mask = F.flatten(F.transform("s", lambda x: F.transform(x["w"], lambda _: x["m"])))
    return seq.select(conv, F.flatten(F.col("s.w")).alias("tokens"), mask.alias("loss_mask"))


def preference_pairs(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Consecutive assistant turns of a conversation as (chosen, rejected), with the first user turn as prompt."""
    w = Window.partitionBy(conv).orderBy(turn)
    first = F.min(F.when(F.col(role) == "user", F.struct(turn, text))).over(Window.partitionBy(conv))[text]
    a = df.withColumn("prompt", first).filter(F.col(role) == "assistant").withColumn("rejected", F.lead(text).over(w))
    return a.filter("rejected is not null").select(conv, turn, "prompt", F.col(text).alias("chosen"), "rejected")
