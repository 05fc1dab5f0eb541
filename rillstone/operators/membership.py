"""A broadcast bitmap that keeps rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_names(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that clash with none of df's."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        own = name
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out[name] = own
    return out


#: Bits of a membership filter, at most: 128 MB, however many members there are.
MOST_BITS = 1 << 30


def with_membership(df: DataFrame, key: Column, members: DataFrame, out: str) -> DataFrame:
    """df with the boolean ``out``: false only if no row of ``members`` (one long column, hashes) equals ``key``.

    A bitmap that is broadcast: 32 bits a member up to MOST_BITS, so its size has a bound. True
    means maybe; an exact join has to follow. It keeps rows that surely don't take part out of a shuffle.
    """
    column, bits = members.columns[0], 1 << 20
    n = members.count()
    while bits < 32 * n and bits < MOST_BITS:
        bits *= 2
    own = free_names(df, "_word", "_bits")
    at = F.pmod(F.col(column), F.lit(bits))
    bitmap = members.filter(F.col(column).isNotNull()).groupBy(F.floor(at / 32768).cast("int").alias(own["_word"])).agg(F.bitmap_construct_agg((at % 32768).cast("long")).alias(own["_bits"]))
    place = F.pmod(key, F.lit(bits))
    byte = F.substring(own["_bits"], (place % 32768 / 8).cast("int") + 1, F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1
    df = df.withColumn(own["_word"], F.floor(place / 32768).cast("int")).join(F.broadcast(bitmap), own["_word"], "left")
    return df.withColumn(out, F.coalesce(hit, F.lit(False))).drop(*own.values())


#: Keys that are broadcast as they are: some megabytes.
SMALL = 200_000


def keep_members(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows of df whose long ``key`` is in ``members`` (one column of that name): a broadcast of up to SMALL counted keys, else the bitmap before a shuffled join."""
    keys = members.select(key).distinct()
    if keys.limit(SMALL + 1).count() <= SMALL:
        return df.join(F.broadcast(keys), key, "left_semi")
    maybe = free_names(df, "_maybe")["_maybe"]
    return with_membership(df, F.col(key), keys, maybe).filter(F.col(maybe)).drop(maybe).join(keys, key, "left_semi")
