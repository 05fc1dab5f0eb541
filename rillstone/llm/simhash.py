"""SimHash near-dedup with vantage-point trees over Hamming distance.

Equal fingerprints are one node. A tree's inner nodes hold a vantage point and a distance: fingerprints up to that
distance go left, the others right, and the leaves are shards. A search with radius r goes left if its distance less r is in
reach, and right if its distance plus r is beyond (triangle inequality), so whatever is within r of it lives in a shard that it visits.

Over all 64 bits nearly every fingerprint is 32 +- 4 bits from any vantage point, so bounds with radius 4 cut off little. Therefore there
is a forest: the bits are cut into BITS + agree parts, and two fingerprints that differ in at most BITS bits are equal in
``agree`` of them. Each choice of so many parts is a metric of its own with a tree of its own, in which radius 0
is enough; ``agree`` = 0 is the one tree over all bits with radius BITS, where searches do visit several shards. More parts
agree where there are more fingerprints, so that shards don't grow with them.

Inside a shard the fingerprints are compared on all bits, again by distance to a vantage point, the shard's smallest one: those within BITS of it are linked
to it and need no comparison among themselves; two others can only be linked if their distances to it differ by BITS at most. A shard
of more than BLOCK fingerprints is cut into shells of equal distance, and shells into cells of at most BLOCK or so; each pair of cells in reach of
each other is a task. Only a spanning forest of the links leaves a task, so n copies of a text give about n links.

Defined results: a null text is empty; texts without words have the fingerprint zero, which is linked like any other; fewer than WIDTH words are one shingle; very long texts
are hashed whole, in windows; rows that repeat share a node; null doc_ids are larger than any other, and the smallest doc_id names a component, so ties don't arise;
an empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, lean, written
from .neardup import components

WIDTH, SEED, BITS = 4, 42, 4
#: Fingerprints of a shard that trees aim at, and of a comparison's side, about.
SHARD, BLOCK = 1024, 4096
#: Fingerprints that trees are built from, about: those with the smallest hashes.
SAMPLE = 1 << 15
#: Bytes of a text that are hashed at once.
WINDOW = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _ones(words: list[bytes], width: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit."""
    import xxhash

    buffer, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(buffer[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None) -> int:
    """64 bits: those that are set in over half of the shingles' hashes, repeats included."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only, ASCII white space only
    ones, n, words, at = np.zeros(64, dtype=np.int64), 0, [], 0
    while at < len(raw):
        gap = _BLANK.search(raw, at + WINDOW)
        end = gap.start() if gap else len(raw)
        words = words[-(WIDTH - 1) :] + raw[at:end].split() if n else words + raw[at:end].split()
        if len(words) >= WIDTH:
            ones += _ones(words, WIDTH)
            n += len(words) - WIDTH + 1
        at = end
    if not n and words:
        ones, n = _ones(words, len(words)), 1
    return sum(1 << int(b) for b in np.nonzero(2 * ones > n)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def metrics(agree: int) -> list[tuple[int, int]]:
    """(bits, radius) of each tree: whatever differs in BITS bits at most is within the radius in one of them."""
    if not agree:
        return [((1 << 64) - 1, BITS)]
    parts = [sum(1 << b for b in range(k, 64, BITS + agree)) for k in range(BITS + agree)]
    return [(sum(chosen), 0) for chosen in itertools.combinations(parts, agree)]


def agreeing(n: int) -> int:
    """How many parts have to agree among n fingerprints: shards of chance hold about SHARD as long as a tree has bits for that."""
    agree = 1
    while n > SHARD << (64 * agree // (BITS + agree)) and agree < 4:
        agree += 1
    return agree


@dataclass
class Tree:
    """vantage[i], reach[i] and children of inner nodes; a child below 0 is the leaf -child - 1."""

    bits: int
    radius: int
    vantage: np.ndarray
    reach: np.ndarray
    children: np.ndarray
    root: int

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in fps, leaf) for each leaf within the radius."""
        row, node = np.arange(len(fps)), np.full(len(fps), self.root)
        rows, leaves = [], []
        while len(row):
            ended = node < 0
            rows.append(row[ended])
            leaves.append(-node[ended] - 1)
            row, node = row[~ended], node[~ended]
            d = np.bitwise_count((fps[row] ^ self.vantage[node]) & np.uint64(self.bits)).astype(int)
            left, right = d - self.radius <= self.reach[node], d + self.radius > self.reach[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.children[node[left], 0], self.children[node[right], 1]])
        return np.concatenate(rows), np.concatenate(leaves)


def grow(sample: np.ndarray, bits: int, radius: int, levels: int) -> Tree:
    """A tree of so many levels at most over the sample; of a few vantage points at each node the one that halves it best."""
    mask = np.uint64(bits)
    vantage, reach, children, leaves = [], [], [], itertools.count()

    def node(keys: np.ndarray, level: int) -> int:
        best = None
        for v in keys[: 8 if level else 0]:
            d = np.bitwise_count(keys ^ v)
            cut = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
            for at in (int(cut) - 1, int(cut)):
                off = abs(2 * int((d <= at).sum()) - len(d))
                if off < len(d) and (best is None or off < best[0]):
                    best = (off, v, at, d <= at)
        if best is None:
            return -next(leaves) - 1
        _, v, at, left = best
        own = len(vantage)
        vantage.append(v)
        reach.append(at)
        children.append([0, 0])
        children[own] = [node(keys[left], level - 1), node(keys[~left], level - 1)]
        return own

    root = node(np.unique(sample & mask)[np.random.default_rng(SEED).permutation(len(np.unique(sample & mask)))], levels)
    return Tree(bits, radius, np.array(vantage, dtype=np.uint64), np.array(reach, dtype=int), np.array(children, dtype=int).reshape(-1, 2), root)


def forest(nodes: DataFrame, n: int, agree: int | None = None, shard: int = SHARD) -> list[Tree]:
    """Trees for n distinct fingerprints, built from about SAMPLE of them."""
    share = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.lit(1 << 32)) < int(min(1.0, SAMPLE / max(n, 1)) * 2**32)
    sample = np.array(sorted(r["fp"] for r in nodes.filter(share).select("fp").collect()), dtype=np.int64).view(np.uint64)
    levels = max(0, n // shard).bit_length()
    return [grow(sample, bits, radius, levels) for bits, radius in metrics(agreeing(n) if agree is None else agree)]


def _shards(batches: Iterator[pa.RecordBatch], trees: list[Tree]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches, 1 << 14):
        fps = np.asarray(batch.column(0)).view(np.uint64)
        for k, tree in enumerate(trees):
            row, leaf = tree.visits(fps)
            yield pa.RecordBatch.from_arrays([pa.array((k << 32) + leaf, pa.int64()), pa.array(fps[row].view(np.int64))], names=["shard", "fp"])


def links(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (a member, the smallest of those it is connected to): a spanning forest of the links inside left, or between left and right.

    Places are those in left followed by right. The vantage point is the smallest of all.
    """
    fps = left if right is None else np.concatenate([left, right])
    d = np.bitwise_count(fps ^ fps.min()).astype(int) if len(fps) else np.zeros(0, dtype=int)
    order = np.lexsort((fps, d))
    fps, d, side = fps[order], d[order], (np.arange(len(fps)) < len(left))[order]
    label = np.arange(len(fps))
    if right is None:
        label[d <= BITS] = 0  # all within reach of the vantage point are linked to it
    rows = np.nonzero(side)[0]
    for k in range(0, len(rows), 256):
        own = rows[k : k + 256]
        low, high = np.searchsorted(d, d[own[0]] - BITS), np.searchsorted(d, d[own[-1]] + BITS, "right")
        near = np.bitwise_count(fps[own, None] ^ fps[None, low:high]) <= BITS
        if right is not None:
            near &= ~side[None, low:high]
        for i in np.nonzero(near.sum(axis=1) > (right is None))[0].tolist():
            met = np.append(label[low:high][near[i]], label[own[i]])
            if (least := met.min()) != met.max():
                label[np.isin(label, met)] = least
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return list(zip(order[moved].tolist(), order[label[moved]].tolist(), strict=True))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of the tasks: columns task, side (0: among themselves or the left side, 1: the right side), fp; rows of a task follow each other."""
    held: list[np.ndarray] = []
    key = None

    def done() -> pa.RecordBatch:
        side, fps = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        fps, pairs = fps.view(np.uint64), []
        if len(fps):
            both = [np.unique(fps[side == s]) for s in (0, 1)]
            fps = np.concatenate(both)
            pairs = links(both[0], both[1] if len(both[1]) else None)
        u, v = (fps[[p[k] for p in pairs]].view(np.int64) if pairs else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        task, side, fps = (np.asarray(batch.column(n)) for n in ("task", "side", "fp"))
        cuts = [0, *(np.nonzero(task[1:] != task[:-1])[0] + 1).tolist(), len(task)] if len(task) else []
        for start, end in itertools.pairwise(cuts):
            if task[start] != key and held:
                yield done()
                held = []
            key = task[start]
            held.append((side[start:end], fps[start:end]))
    if held:
        yield done()


def _tasks(rows: DataFrame) -> DataFrame:
    """Links of rows task, side, fp; a task is a string or a number that names what is compared."""
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_compared, "u long, v long")


def shard_links(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect whatever is linked within a shard; members: shard, fp, a table."""
    stats = written(members.groupBy("shard").agg(F.count(F.lit(1)).alias("members"), F.min("fp").alias("vantage")).filter("members > 1"), "simhash-shards")
    total = members.count()
    met = hot_join(members, stats, ["shard"], "members", total)
    small = _tasks(met.filter(F.col("members") <= block).select(F.col("shard").alias("task"), F.lit(0).alias("side"), "fp"))
    big = met.filter(F.col("members") > block).withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).cast("int"))
    big = written(big, "simhash-big")
    if big.isEmpty():
        return small
    # within reach of the vantage point: linked to it; the others meet cell by cell
    stars = big.filter((F.col("d") <= BITS) & (F.col("d") > 0)).select(F.col("fp").alias("u"), F.col("vantage").alias("v"))
    shells = written(big.groupBy("shard", "d").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cells")), "simhash-shells")  # 65 a shard at most
    other = shells.select("shard", F.col("d").alias("d2"), F.col("cells").alias("cells2"))
    pairs = shells.join(other, "shard").filter((F.col("d") <= F.col("d2")) & (F.col("d2") - F.col("d") <= BITS) & (F.col("d2") > BITS))
    near = pairs.groupBy("shard", "d").agg(F.first("cells").alias("cells"), F.collect_list(F.struct("d2", "cells2")).alias("up"))
    near = near.join(pairs.groupBy("shard", F.col("d2").alias("d")).agg(F.first("cells2").alias("own"), F.collect_list(F.struct(F.col("d").alias("d2"), F.col("cells").alias("cells2"))).alias("down")), ["shard", "d"], "full")
    near = near.select("shard", "d", F.coalesce("cells", "own").alias("cells"), F.coalesce("up", F.array().cast("array<struct<d2:int,cells2:int>>")).alias("up"), F.coalesce("down", F.array().cast("array<struct<d2:int,cells2:int>>")).alias("down"))
    rows = big.select("shard", "d", "fp").join(near, ["shard", "d"])  # a shell's row, wide by 9 shells at most
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
    at = F.concat_ws(":", "d", "cell")
    each = lambda c, least: F.flatten(F.transform(c, lambda x: F.transform(F.sequence(F.lit(0), x["cells2"] - 1), lambda k: F.struct(x["d2"].alias("d2"), k.alias("k")))))
    named = lambda a, b: F.concat_ws("|", F.col("shard").cast("string"), a, b)
    theirs = F.concat_ws(":", F.col("x.d2"), F.col("x.k"))
    same = (F.col("x.d2") == F.col("d")) & (F.col("x.k") == F.col("cell"))
    # a pair of cells has one task: the lower distance is the left side, and of one distance the smaller cell
    up = rows.select("*", F.explode(each("up", 0)).alias("x")).filter((F.col("x.d2") > F.col("d")) | (F.col("x.k") >= F.col("cell"))).select(named(at, theirs).alias("task"), F.lit(0).alias("side"), "fp")
    down = rows.select("*", F.explode(each("down", 0)).alias("x")).filter(((F.col("x.d2") < F.col("d")) | (F.col("x.k") < F.col("cell"))) & ~same).select(named(theirs, at).alias("task"), F.lit(1).alias("side"), "fp")
    return small.unionByName(stars).unionByName(_tasks(up.unionByName(down)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs, as a table; fp: the bits as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]
    return written(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), "simhash-rows")


def linked(rows: DataFrame, agree: int | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``fingerprints``."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    n = nodes.count()
    trees = forest(nodes, n, agree, shard)
    members = written(nodes.select("fp").mapInArrow(functools.partial(_shards, trees=trees), "shard long, fp long"), "simhash-members")
    labels = components(shard_links(members, block))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = nodes.join(named.join(least, "label").select("fp", "component_id"), "fp", "left").select("fp", "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    return hot_join(rows, written(known, "simhash-known"), ["fp"], "copies", rows.count()).select("doc_id", "fp", "component_id")


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id."""
    return linked(fingerprints(docs)).select("doc_id", shown(F.col("fp")).alias("fingerprint"), "component_id")
