"""Centroid clustering: k-means over integer vectors, filtered by ball trees.

Each Arrow slice of a partition becomes metric trees of up to TREE vectors, built once. A node is a ball: its first and
last place in tree order (so its count), the integer sum of its vectors and the radius around their mean.
A round walks each tree from its root: by the triangle inequality a centroid that is farther from the ball's
middle than the nearest one by more than two radii can't be nearest to any of its vectors. A ball with
one candidate left is assigned whole, with its sum and count; the others hand their candidates down to both
halves, and leaves compare their vectors exactly, in integers. Bounds are taken with a margin
over their rounding, so the result equals that of comparing everything.

A task sends the sums of at most k clusters; the driver gets k rows a round, and the centroids are k times the dimensions.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinity are left out; components
beyond 2^27 in size (2,097,152 before scaling) count as 2^27, so that each squared distance fits a long, and an inertia beyond a long is the largest long;
a null vec_id is an empty string in the seed's hash; rows that repeat count each, and ties among seeds go by vec_id, null first, and vector; with fewer than k vectors there
are as many centroids; an empty table gives no rows. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, written

DIMENSIONS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a tree and of a leaf, at most.
TREE, LEAF = 1024, 32
#: Components are held within this size.
MOST = 1 << 27
_LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the integer vectors floor(scale * x) of the rows that are kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "embedding").filter((F.size("embedding") == dimensions) & finite)
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    return kept.select("vec_id", F.transform("embedding", whole).alias("v"))


def seeds(whole: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest hashes; k rows reach the driver."""
    text = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = whole.select(F.sha2(text.cast("binary"), 256).alias("h"), "vec_id", "v").orderBy("h", "vec_id", "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def build(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A ball tree as (order, bounds, radius, sums); node i has the children 2i + 1 and 2i + 2, all leaves are on the last level."""
    depth = 0
    while -(-len(v) >> depth) > leaf:
        depth += 1
    order, n = np.arange(len(v)), (2 << depth) - 1
    bounds, radius, sums = np.zeros((n, 2), dtype=np.int64), np.zeros(n), np.zeros((n, v.shape[1]), dtype=np.int64)
    bounds[0] = 0, len(v)
    for i in range(n):
        start, end = bounds[i]
        own = v[order[start:end]].astype(np.int64)
        sums[i] = own.sum(axis=0)
        if not len(own):  # leaves of one vector leave their sibling empty
            bounds[2 * i + 1 : 2 * i + 3] = start
            continue
        away = own - sums[i] / len(own)
        far = (away * away).sum(axis=1)
        radius[i] = np.sqrt(far.max())
        if 2 * i + 2 < n:
            a = own[far.argmax()]
            b = own[((own - a).astype(float) ** 2).sum(axis=1).argmax()]
            half = (len(own) + 1) // 2
            side = np.argpartition((own @ (b - a).astype(float)), half - 1) if len(own) > 1 else np.zeros(1, dtype=int)
            order[start:end] = order[start:end][side]
            bounds[2 * i + 1], bounds[2 * i + 2] = (start, start + half), (start + half, end)
    return order, bounds, radius, sums


def nearest(v: np.ndarray, bounds: np.ndarray, radius: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The nearest centroid of each vector in tree order, ties to the smaller number, and the (ball, centroid) pairs that were assigned whole."""
    label, balls = np.full(len(v), -1, dtype=np.int32), []
    at, possible = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
    while len(at):
        filled = bounds[at, 1] > bounds[at, 0]
        at, possible = at[filled], possible[filled]
        middle = sums[at] / (bounds[at, 1] - bounds[at, 0])[:, None]
        d = np.sqrt(((middle[:, None, :] - centroids[None]) ** 2).sum(axis=2))
        reach = np.where(possible, d, np.inf).min(axis=1) + 2 * radius[at]
        possible &= d <= (reach + 1e-9 * (1 + reach))[:, None]
        sure = possible.sum(axis=1) == 1
        for i, c in zip(at[sure].tolist(), possible[sure].argmax(axis=1).tolist(), strict=True):
            label[bounds[i, 0] : bounds[i, 1]] = c
            balls.append((i, c))
        at, possible = at[~sure], possible[~sure]
        last = 2 * at + 2 >= len(radius)
        for i, own in zip(at[last].tolist(), possible[last], strict=True):
            start, end = bounds[i]
            which = np.nonzero(own)[0]
            off = v[start:end, None, :].astype(np.int64) - centroids[None, which]
            label[start:end] = which[(off * off).sum(axis=2).argmin(axis=1)]
        at, possible = np.concatenate([2 * at[~last] + 1, 2 * at[~last] + 2]), np.concatenate([possible[~last], possible[~last]])
    return label, balls


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int, tree: int, leaf: int) -> Iterator[pa.RecordBatch]:
    names = ["ids", "v", "bounds", "radius", "sums"]
    for batch in lean(batches, tree):
        if not batch.num_rows:
            continue
        v = np.asarray(batch.column(1).flatten()).reshape(-1, dimensions)
        order, *nodes = build(v, leaf)
        ids = batch.column(0).take(pa.array(order))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (v[order].astype("<i4"), *nodes)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _read(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple]:
    """(ids, v, bounds, radius, sums) of each tree."""
    for k in range(batch.num_rows):
        v, bounds, radius, sums = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=t) for c, t in ((1, "<i4"), (2, "<i8"), (3, "<f8"), (4, "<i8")))
        yield batch.column(0)[k].values, v.reshape(-1, dimensions), bounds.reshape(-1, 2), radius, sums.reshape(-1, dimensions)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and sum of each cluster, over all trees of the task."""
    k, dimensions = centroids.shape
    count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
    for batch in lean(batches, 64):
        for _, v, bounds, radius, sums in _read(batch, dimensions):
            label, balls = nearest(v, bounds, radius, sums, centroids)
            for i, c in balls:
                count[c] += bounds[i, 1] - bounds[i, 0]
                total[c] += sums[i]
                label[bounds[i, 0] : bounds[i, 1]] = -1  # counted whole
            for c in np.unique(label[label >= 0]):
                count[c] += (label == c).sum()
                total[c] += v[label == c].sum(axis=0, dtype=np.int64)
    used = np.nonzero(count)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])


def _labels(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches, 64):
        for ids, v, *nodes in _read(batch, centroids.shape[1]):
            label, _ = nearest(v, *nodes, centroids)
            off = v - centroids[label]
            yield pa.RecordBatch.from_arrays([ids, pa.array(label), pa.array((off * off).sum(axis=1))], names=["vec_id", "cluster", "distance"])


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, tree: int = TREE, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector as a table, and the centroids after the last round."""
    whole = whole_vectors(vectors, dimensions, scale)
    kind = dict(whole.dtypes)["vec_id"]
    centroids = seeds(whole, k).reshape(-1, dimensions)
    build_trees = functools.partial(_trees, dimensions=dimensions, tree=tree, leaf=leaf)
    trees = written(whole.mapInArrow(build_trees, f"ids array<{kind}>, v binary, bounds binary, radius binary, sums binary"), "ball-trees")
    for _ in range(rounds if len(centroids) else 0):
        part = trees.mapInArrow(functools.partial(_sums, centroids=centroids), "cluster int, n long, total array<long>")
        means = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dimensions)]
        for row in part.groupBy("cluster").agg(F.sum("n").alias("n"), *means).collect():  # k rows at most
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dimensions)]
    labelled = trees.mapInArrow(functools.partial(_labels, centroids=centroids), f"vec_id {kind}, cluster int, distance long")
    return written(labelled, "ball-labels"), centroids


def _by_cluster(values: list, kind: str) -> Column:
    return F.get(F.array(*[F.lit(x).cast(kind) for x in values]) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))


def report(vectors: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    labelled, centroids = cluster(vectors)
    sums = {r["cluster"]: int(r["s"]) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return labelled.select(
        "vec_id", "cluster", "distance",
        _by_cluster([min(_LONG, sums.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(min(_LONG, sum(sums.values()))).cast("long").alias("inertia"),
        _by_cluster(hashes, "string").alias("centroid_sha256"),
    )


def _sql_round(k: int) -> str:
    """Assigns to the centroids of table c{k} and makes those of c{k + 1}; squares of integers below 2^53 are exact in doubles."""
    return f"""
a{k} AS (SELECT rid, i, x, cluster FROM (SELECT rid, cluster FROM (
    SELECT e.rid, c.cluster, row_number() OVER (PARTITION BY e.rid ORDER BY sum((e.x - c.x) * (e.x - c.x)), c.cluster) AS place
    FROM e JOIN c{k} c ON e.i = c.i GROUP BY e.rid, c.cluster) r WHERE place = 1) n JOIN e USING (rid)),
c{k + 1} AS (SELECT c.cluster, c.i, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT cluster, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{k} GROUP BY cluster, i) m
    ON m.cluster = c.cluster AND m.i = c.i)"""


SQL = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS rid, vec_id, embedding FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
e AS (SELECT rid, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM k CROSS JOIN range(1, {DIMENSIONS + 1}) t(i)),
c0 AS (SELECT rid AS cluster, i, x FROM e WHERE rid < {K}),
{",".join(_sql_round(k) for k in range(ROUNDS))},
d AS (SELECT rid, cluster, CAST(distance AS BIGINT) AS distance FROM (
    SELECT e.rid, c.cluster, sum((e.x - c.x) * (e.x - c.x)) AS distance, row_number() OVER (PARTITION BY e.rid ORDER BY sum((e.x - c.x) * (e.x - c.x)), c.cluster) AS place
    FROM e JOIN c{ROUNDS} c ON e.i = c.i GROUP BY e.rid, c.cluster) r WHERE place = 1),
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT k.vec_id, CAST(d.cluster AS INTEGER) AS cluster, d.distance, CAST(sum(d.distance) OVER (PARTITION BY d.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(d.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM d JOIN k USING (rid) JOIN h USING (cluster)
"""
