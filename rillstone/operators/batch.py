"""Shape operators on batches of rows: union, chunk, repeat, pad, slice, reorder, balance, sample.

Order is always a column; nothing depends on the order of partitions.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def numbered(df: DataFrame, order: list[str], out: str = "row") -> DataFrame:
    """Row numbers from 0 in a global order, from per-range counts (one row a range); no task sees all rows.

    The ranges are written once: sampled borders may differ from one run of a plan to the next.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + inside - 1).cast("long")).drop("_part", "_before")


def positional_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of two batches side by side; a column of both must agree in every row, or the job fails."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    right = b.select(key, *[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in b.columns if c != key])
    joined = a.join(right, key)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(dict(a.dtypes)[c]))).drop(f"_{c}")
    return joined


def chunk(df: DataFrame, n: int, total: int, row: str = "row") -> DataFrame:
    """Equal contiguous chunks; total must be divisible."""
    if total % n:
        raise ValueError(f"{total} rows don't split into {n} chunks")
    return df.withColumn("chunk", F.floor(F.col(row) / (total // n)).cast("int"))


def repeat(df: DataFrame, times: int | Column, interleave: bool = True, row: str = "row", total: int | None = None) -> DataFrame:
    """Rows repeated, each next to its copies, or the whole batch tiled. times may be a column when interleaved."""
    n = F.lit(times) if isinstance(times, int) else times
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    if interleave:
        return out.withColumn("new_row", F.col(row) * n + F.col("copy")) if isinstance(times, int) else out
    if total is None:
        raise ValueError("tiling needs the number of rows")
    return out.withColumn("new_row", F.col("copy") * total + F.col(row))


def pad_cyclic(df: DataFrame, total: int, multiple: int, row: str = "row") -> DataFrame:
    """Rows from the start once more until the number is a multiple."""
    missing = -total % multiple
    extra = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-missing // max(total, 1)) - 1))))).withColumn("new_row", F.lit(total).cast("long") + F.col("k") * total + F.col(row)).filter(F.col("new_row") < total + missing)
    return df.withColumn("new_row", F.col(row).cast("long")).unionByName(extra.drop("k").select(*df.columns, "new_row"))


def take_slice(df: DataFrame, start: int, stop: int, step: int = 1, row: str = "row") -> DataFrame:
    return df.filter((F.col(row) >= start) & (F.col(row) < stop) & ((F.col(row) - start) % step == 0))


def modulo_shard(df: DataFrame, n: int, k: int, row: str = "row") -> DataFrame:
    return df.filter(F.col(row) % n == k)


def unfold(df: DataFrame, column: str) -> DataFrame:
    """A list column's elements as rows; the other columns repeat."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("part", column))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those with the smallest seeded hashes (a distributed top-n)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)).cast("binary")), key).limit(n)


def systematic_resample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """About n draws with replacement in proportion to weight: each row is drawn floor(e) times and once more with the chance of e's fraction."""
    total = df.agg(F.sum(weight).alias("_total"))
    rows = df.crossJoin(F.broadcast(total)).withColumn("_e", weight / F.col("_total") * n)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("_e") + (u < F.col("_e") - F.floor("_e")).cast("int")).cast("int")
    return rows.withColumn("_times", times).filter("_times > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_e", "_times", "_total")


def largest_differencing(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Karmarkar-Karp: k parts of indices with near-equal sums; with equal, parts of equal length (len(sizes) must be a multiple of k)."""
    if equal and len(sizes) % k:
        raise ValueError("equal parts need a multiple of k items")
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    groups = [order[a : a + k] for a in range(0, len(order), k)] if equal else [[i] for i in order]
    for tie, g in enumerate(groups):
        parts = [(sizes[i], [i]) for i in g] + [(0, [])] * (k - len(g))
        parts.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), tie, parts))
    tie = len(groups)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), tie, parts))
        tie += 1
    return sorted((sorted(p[1]) for p in heap[0][2]), key=lambda p: p[:1]) if heap else [[] for _ in range(k)]


def greedy_least_loaded(sizes: list[int], k: int) -> list[int]:
    """In order, each item to the part with the least so far."""
    heap = [(0, p) for p in range(k)]
    out = []
    for x in sizes:
        load, p = heapq.heappop(heap)
        out.append(p)
        heapq.heappush(heap, (load + x, p))
    return out


def balanced_partitions(df: DataFrame, batch: str, key: str, size: str, k: int) -> DataFrame:
    """Each batch's rows dealt into k parts of near-equal size. A batch is what one training step reads: bounded."""
    kinds = dict(df.dtypes)

    def deal(pdf):
        pdf = pdf.sort_values(key)
        where = {}
        for p, rows in enumerate(largest_differencing(pdf["size_"].tolist(), k)):
            where.update(dict.fromkeys(rows, p))
        return pdf.assign(part=[where[i] for i in range(len(pdf))]).rename(columns={"size_": size})[[batch, key, size, "part"]]

    rows = df.select(batch, key, F.col(size).alias("size_"))
    return rows.groupBy(batch).applyInPandas(deal, f"{batch} {kinds[batch]}, {key} {kinds[key]}, {size} {kinds[size]}, part int")


def unbalance(df: DataFrame, batch: str, part: str, size: str) -> DataFrame:
    sums = df.groupBy(batch, part).agg(F.sum(size).alias("s"))
    return sums.groupBy(batch).agg(F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"))


def micro_batches(total: int, most: int, least: int = 1, multiple: int = 1) -> int:
    """Number of micro-batches of at most ``most`` tokens, at least ``least``, rounded up to a multiple."""
    n = max(least, -(-total // most))
    return -(-n // multiple) * multiple


def allocate_budget(df: DataFrame, group: str, key: str, weight: str, budget: int) -> DataFrame:
    """Whole units in proportion to weight: floors, then one more each to the largest weights until the budget is used."""
    w = Window.partitionBy(group)
    exact = F.col(weight) / F.sum(weight).over(w) * budget
    rows = df.withColumn("units", F.floor(exact).cast("long"))
    left = F.lit(budget) - F.sum("units").over(w)
    place = F.row_number().over(w.orderBy(F.col(weight).desc(), key))
    return rows.withColumn("_left", left).withColumn("_place", place).withColumn("units", F.col("units") + (F.col("_place") <= F.col("_left")).cast("long")).drop("_left", "_place")


def interpolated_budget(x: Column, low: float, high: float, least: int, most: int) -> Column:
    """Clamped linear interpolation from [low, high] to [least, most], half to even."""
    share = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.bround(least + share * (most - least)).cast("int")


def uncertainty(reference: Column, work: Column, spread: Column, eps: float = 1e-6) -> Column:
    return F.sqrt(F.abs(reference - work) / (spread + eps) + eps)


def rows_concat(batches: list[DataFrame], row: str = "row") -> DataFrame:
    """Batches one after the other: columns of the first, rows renumbered from the counts of the batches before."""
    columns, out, done = batches[0].columns, None, 0
    for b in batches:
        if set(b.columns) != set(columns):
            raise ValueError(f"columns differ: {sorted(set(b.columns) ^ set(columns))}")
        part = b.select(*columns).withColumn(row, F.col(row) + F.lit(done))
        out = part if out is None else out.unionByName(part)
        done += b.count()
    return out


def pad_with_row(df: DataFrame, total: int, missing: int, last: bool = False, row: str = "row") -> DataFrame:
    """Copies of the first or last row behind the batch."""
    which = df.filter(F.col(row) == (total - 1 if last else 0))
    copies = which.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(missing - 1)))) if missing > 0 else which.withColumn("_k", F.lit(0)).limit(0)
    return df.unionByName(copies.withColumn(row, (F.lit(total) + F.col("_k")).cast(dict(df.dtypes)[row])).drop("_k"))


def mini_batches(df: DataFrame, total: int, size: int, epochs: int, seed: int | None = None, row: str = "row") -> DataFrame:
    """(epoch, mini_batch, place) for each row and epoch; with a seed, the order of an epoch is that of seeded hashes. total must be divisible by size."""
    if total % size:
        raise ValueError(f"{total} rows don't split into mini-batches of {size}")
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return rows.withColumn("mini_batch", F.floor(F.col(row) / size).cast("int")).withColumn("place", (F.col(row) % size).cast("int"))
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.col(row))))
    rows = numbered(rows, ["epoch", "_h"], "_at").drop("_h")
    at = F.col("_at") - F.col("epoch") * total
    return rows.withColumn("mini_batch", F.floor(at / size).cast("int")).withColumn("place", (at % size).cast("int")).drop("_at")


def pick(df: DataFrame, where: list[int] | list[bool] | DataFrame, row: str = "row") -> DataFrame:
    """Rows by a list of numbers, in its order and as often as it says, or by a mask; new numbers are in ``row``. A long list is given as a table (place, row)."""
    spark = df.sparkSession
    if not isinstance(where, DataFrame):
        if where and isinstance(where[0], bool):
            where = [i for i, keep in enumerate(where) if keep]
        where = spark.createDataFrame(list(enumerate(where)), "place long, row long")
    wanted = where.select(F.col("place").alias("_place"), F.col("row").alias("_row"))
    return df.join(wanted, F.col(row) == F.col("_row")).drop(row, "_row").withColumnRenamed("_place", row).select(*df.columns)


def item(df: DataFrame, at, total: int, row: str = "row") -> DataFrame:
    """One row, a slice, or picked rows, by the type of the index; negative numbers count from the end."""
    if isinstance(at, slice):
        start, stop, step = at.indices(total)
        return take_slice(df, start, stop, step, row)
    if isinstance(at, int):
        if not -total <= at < total:
            raise IndexError(at)
        return df.filter(F.col(row) == at % total)
    return pick(df, list(at), row)


def project(df: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen columns, in df's order; names that df lacks are an error."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(*[c for c in df.columns if c in keys])


def pop(df: DataFrame, keys: list[str], row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(the chosen columns, the batch without them); both keep the row number."""
    return project(df, [row, *keys]), df.drop(*keys)


def renamed(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names and {len(new)} new ones")
    project(df, old)
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def reordered(df: DataFrame, order: DataFrame, row: str = "row") -> DataFrame:
    """The batch in the order of a permutation (place, row)."""
    return pick(df, order, row)


def merged(a: dict, b: dict) -> dict:
    """Two dicts; a key of both must have equal values."""
    unlike = [k for k in a.keys() & b.keys() if a[k] != b[k]]
    if unlike:
        raise ValueError(f"keys differ: {sorted(unlike)}")
    return {**a, **b}


def checked_partitions(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Balanced partitions, each sorted, that hold every index exactly once."""
    parts = [sorted(p) for p in largest_differencing(sizes, k, equal)]
    if sorted(i for p in parts for i in p) != list(range(len(sizes))) or any(not p for p in parts):
        raise ValueError(f"{len(sizes)} items don't fill {k} partitions")
    return parts


def balanced_order(parts: list[list[int]]) -> list[int]:
    """The batch's order with one partition after the other."""
    return [i for p in parts for i in p]


def shared(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that all tables hold."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key).distinct(), key, "left_semi")
    return out


def loader(df: DataFrame, size: int, drop_last: bool, row: str = "row") -> DataFrame:
    """Fixed batches in order; training drops the last one if it isn't full, validation keeps it."""
    out = df.withColumn("batch", F.floor(F.col(row) / size).cast("long"))
    if not drop_last:
        return out
    full = out.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).select("batch")
    return out.join(full, "batch", "left_semi")


def useful_rows(df: DataFrame, useful: DataFrame, key: str, least: int) -> DataFrame | None:
    """The rows whose prompts are still useful; None, the sign to stop, if fewer prompts than ``least`` are."""
    kept = useful.select(key).distinct()
    return None if kept.limit(least).count() < least else df.join(kept, key, "left_semi")


def sampler(df: DataFrame, key: str, shuffle: bool, seed: int = 0) -> DataFrame:
    """Rows with their place: seeded, by hashes that every engine gives alike, or in the key's order."""
    order = ["_h", key] if shuffle else [key]
    rows = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))) if shuffle else df
    return numbered(rows, order, "place").drop("_h")


def spread(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, largest, smallest and sample deviation over all ranks."""
    return df.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"), F.stddev_samp(value).alias("std"))


def as_lists(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key with a list per column, in order; a key's rows are what one step holds."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*key).agg(rows.alias("_rows")).select(*key, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def steps_for_budget(budget: int, per_step: int) -> int:
    return budget // per_step


def within_budget(shards: DataFrame, order: str, tokens: str, budget: int, held_out: int = 0) -> DataFrame:
    """Shards in order whose running tokens stay within the budget, after the last ``held_out`` are set apart. One row a shard: a listing, not the data."""
    w = Window.orderBy(order)
    rows = shards.withColumn("_back", F.row_number().over(Window.orderBy(F.desc(order)))).filter(F.col("_back") > held_out)
    return rows.withColumn("_sum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= budget).drop("_back", "_sum")


def resample_weights(score: Column, method: str = "pow", power: float = 2.0, extremes: tuple[Column, Column] | None = None) -> Column:
    """Weights of a resampling: a power of the size, 1 for the largest and smallest scores, or 0.4 for the largest and 0.1 for others; at least 1e-8."""
    if method == "pow":
        w = F.pow(F.abs(score), F.lit(float(power)))
    elif method in ("max_min", "max_random") and extremes is not None:
        low, high = extremes
        w = F.when((score == high) | (score == low), 1.0).otherwise(0.0) if method == "max_min" else F.when(score == high, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}, or no extremes given")
    return F.greatest(w + 1e-8, F.lit(1e-8))


def drawn(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0, units: float = 1e6) -> DataFrame:
    """n independent draws with replacement: (draw, row's columns). Weights count in whole units, one at least.

    A draw's point is an MD5 of seed and number; it falls to the row in whose share of the running weights it lies. Running weights come
    from per-range totals, and draws meet rows in an equi-join on equal slices of the whole.
    """
    w = F.greatest(F.round(weight.cast("double") * units), F.lit(1.0)).cast("long")
    rows = written(df.withColumn("_w", w).repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "drawn")
    totals = rows.groupBy("_part").agg(F.sum("_w").alias("_t"))
    before = totals.select("_part", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = rows.agg(F.sum("_w")).first()[0] or 0
    width = max(1, -(-whole // max(1, n)))
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(before), "_part").withColumn("_low", F.col("_before") + inside)  # one row a range
    slices = F.sequence(F.floor(F.col("_low") / width).cast("long"), F.floor((F.col("_low") + F.col("_w") - 1) / width).cast("long"))
    rows = rows.withColumn("_slice", F.explode(slices))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    draws = df.sparkSession.range(n if whole else 0).select(F.col("id").alias("draw"), F.floor(u * whole).cast("long").alias("_at"))
    draws = draws.withColumn("_slice", F.floor(F.col("_at") / width).cast("long"))
    hit = draws.join(rows, "_slice").filter((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_low") + F.col("_w")))
    return hit.select("draw", *df.columns)


def padded_chunks(df: DataFrame, total: int, n: int, row: str = "row") -> DataFrame:
    """A batch cycled up to a multiple of n and split into n equal chunks."""
    padded = pad_cyclic(df, total, n, row).drop(row).withColumnRenamed("new_row", row)
    return chunk(padded, n, total + -total % n, row)
