"""MinHash near-dedup by an inverted join over signature coordinates.

A text's set holds its distinct shingles of five words. Equal sets are one node from the start.
A node is posted under each of its signature's (coordinate, value) pairs. Links need at
least MATCHES equal coordinates, so

* pairs that only one node has can't collide: a node with fewer than MATCHES shared pairs drops out;
* of its c shared pairs, only the c - MATCHES + 1 rarest (the prefix) have to be posted, since two nodes
  that agree in MATCHES pairs meet in a prefix; long postings are mostly skipped;
* two nodes are counted in one posting alone, the first they share in both prefixes.

Short postings (up to SHORT nodes) are merged at once: collisions are counted and pairs
over the threshold are candidates. The nodes of a long posting are not paired, they form one
family with whatever candidates join to them. A family is compared in blocks of BLOCK nodes, or fewer where
sets are so large that a block would hold over BLOCK_SHINGLES:
collisions are counted inside the task, pairs over the threshold that aren't yet connected are confirmed on the full
sets, and only a spanning forest of confirmed links leaves the task. In a family of several blocks each block is first
compared with itself and with the family's center. Nodes that this connects to the center, the core, needn't be
compared with each other any more; the others are dealt into blocks of their own and meet each other and the core.
So a family of n copies of one text costs about n, not n squared.

With 48 coordinates and 23 matches, a pair at exactly 0.75 is missed with a chance of about 3e-5.

Defined results: null texts and texts without words have an empty set, component_id = doc_id and no
link; with under five words the whole sequence is the one shingle; very long texts are compared by whole sets; rows that repeat share a node;
null doc_ids are larger than any other, and ties don't arise, as the smallest doc_id names a component and the text's hash decides among texts under
it; an empty table gives no rows. Extra columns are ignored or, in ``drop_near_copies``, kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_names, hot_join, lean, with_membership, written
from .exact_dedup import one_row

WIDTH, COORDINATES, MATCHES = 5, 48, 23
#: A link: PERCENT of the union at least is shared.
PERCENT = 75
SHORT, BLOCK = 64, 512
#: Shingles that a block holds on average, at most: 128 MB.
BLOCK_SHINGLES = 1 << 24
_MIX = 0xD6E8FEB86659FD93


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(w):
        return w
    m, h = max(1, len(w) - WIDTH + 1), None
    for k in range(min(WIDTH, len(w))):
        part = _mix(w[k : k + m] + np.uint64(k + 1))
        h = part if h is None else (h * np.uint64(0x100000001B3)) ^ part
    return np.unique(_mix(h + np.uint64(min(WIDTH, len(w)))))


def _family_of_hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240613)
    return rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(low, (s[k : k + 1024, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def node_key(s: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.astype("<u8").tobytes())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _family_of_hashes()
    for batch in lean(batches):
        keys, sizes, signs = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            sizes.append(len(s))
            keys.append(node_key(s) if len(s) else None)
            signs.append(signature(s, a, b).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "hash", "n", "node", "sig"])


def _short_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of postings, given as lists of members."""
    for batch in batches:
        left, right = [], []
        for posting, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            members.sort(key=lambda m: m["node"])
            sig = np.frombuffer(b"".join(m["sig"] for m in members), dtype="<u4").reshape(len(members), -1)
            mask, size = np.array([m["prefix"] for m in members], dtype=np.int64), np.array([m["n"] for m in members], dtype=np.int64)
            i, j = _candidates(sig, sig, mask, mask, size, size, posting >> 32)
            keep = i < j
            left += [members[k]["node"] for k in i[keep]]
            right += [members[k]["node"] for k in j[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["u", "v"])


def _candidates(a: np.ndarray, b: np.ndarray, mask_a: np.ndarray | None, mask_b: np.ndarray | None, n_a: np.ndarray, n_b: np.ndarray, coordinate: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with MATCHES collisions whose sizes allow a link; with a coordinate, those that share no earlier coordinate in both prefixes."""
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    first = np.zeros(count.shape, dtype=bool)
    for k in range(a.shape[1]):
        same = a[:, k, None] == b[None, :, k]
        count += same
        if coordinate is not None and k < coordinate:
            bit = np.int64(1) << np.int64(k)
            first |= same & ((mask_a & bit) != 0)[:, None] & ((mask_b & bit) != 0)[None, :]
    sizes = 100 * np.minimum(n_a[:, None], n_b[None, :]) >= PERCENT * np.maximum(n_a[:, None], n_b[None, :])
    return np.nonzero((count >= MATCHES) & sizes & ~first)


def is_link(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def block_links(sig: np.ndarray, n: np.ndarray, sets: list[np.ndarray], block: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between blocks i and j (inside i, if they are the same)."""
    left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
    parent = list(range(len(n)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for start in range(0, len(left), 256):  # bounded temporary arrays
        rows = left[start : start + 256]
        p, q = _candidates(sig[rows], sig[right], None, None, n[rows], n[right], None)
        for x, y in zip(rows[p].tolist(), right[q].tolist(), strict=True):
            if (i != j or x < y) and root(x) != root(y) and is_link(sets[x], sets[y]):
                parent[root(y)] = root(x)
                links.append((x, y))
    return links


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of the tasks (family, i, j); rows of a task follow each other."""
    held: list[dict] = []
    key = None

    def done() -> pa.RecordBatch:
        held.sort(key=lambda r: r["node"])
        rows = [r for k, r in enumerate(held) if not k or r["node"] != held[k - 1]["node"]]
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), dtype="<u4").reshape(len(rows), -1)
        n, block = np.array([r["n"] for r in rows], dtype=np.int64), np.array([r["block"] for r in rows])
        links = block_links(sig, n, [np.frombuffer(r["shingles"], dtype="<u8") for r in rows], block, key[1], key[2])
        return pa.RecordBatch.from_arrays(
            [pa.array([key[3]] * len(links), pa.int32()), pa.array([rows[x]["node"] for x, _ in links], pa.binary()), pa.array([rows[y]["node"] for _, y in links], pa.binary())],
            names=["blocks", "u", "v"],
        )

    for batch in batches:
        names = batch.schema.names
        for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            row = dict(zip(names, values, strict=True))
            own = (row["family"], row["i"], row["j"], row["blocks"])
            if own != key:
                if held:
                    yield done()
                held, key = [], own
            held.append(row)
    if held:
        yield done()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (u, v): label is the smallest node reachable. Labels spread and jump, so rounds grow with the logarithm of a path."""
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        moved = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(moved.join(far, "label").select("node", "old", F.least("label", "further").alias("label")), "near-labels")
        changed = not moved.filter("old <> label").isEmpty()
        discard(labels)
        if not changed:
            discard(both)
            return moved.select("node", "label")
        labels = moved


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean(batches):
        keys, sets = [], []
        for text in batch.column(0):
            s = shingles(text.as_py())
            keys.append(node_key(s) if len(s) else None)
            sets.append(s.astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def sharing_nodes(nodes: DataFrame) -> DataFrame:
    """(node, doc_id, n, sig, shared) of the nodes that share MATCHES coordinate-value pairs with others; shared: their (frequency, pair), rarest first."""
    hexed = F.hex("sig")
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
        lambda k: F.shiftleft(k.cast("long"), 32) + F.conv(F.substring(hexed, 8 * k + 1, F.lit(8)), 16, 10).cast("long"),
    )
    posted = nodes.select("node", F.explode(pairs).alias("pair"))
    frequent = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = posted.join(frequent, "pair").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("shared"))
    shared = shared.filter(F.size("shared") >= MATCHES)
    return nodes.join(shared, "node")


def _blocks(n: str, shingles: str) -> Column:
    """Blocks for ``n`` nodes with so many shingles in all."""
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, shingles) of the texts of members (doc_id), perhaps with others; the membership filter keeps other texts out of the shuffle."""
    texts = with_membership(docs.select("doc_id", "text"), F.xxhash64("doc_id"), members.select(F.xxhash64("doc_id").alias("h")), "maybe").filter("maybe")
    return texts.select("text").mapInArrow(_shingle_sets, "node binary, shingles binary")


def _compared(tasks: DataFrame) -> DataFrame:
    """Confirmed links (u, v) of tasks: rows node, family, blocks, n, sig, shingles, block, i, j."""
    tasks = tasks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return tasks.mapInArrow(_families, "blocks int, u binary, v binary")


def family_links(docs: DataFrame, family: DataFrame) -> DataFrame:
    """Confirmed links (blocks, u, v) that connect whatever is linked within a family; family: node, doc_id, n, sig, family, blocks."""
    columns = ["node", "family", "blocks", "n", "sig", "shingles"]
    small, big = family.filter("blocks = 1"), family.filter("blocks > 1")
    zero = F.lit(0)
    held = small.join(_sets_of(docs, small), "node").select(*columns, zero.alias("block"), zero.alias("i"), zero.alias("j"))
    if big.isEmpty():
        return written(_compared(held), "near-links")
    big = written(big.join(_sets_of(docs, big), "node").dropDuplicates(["node"]).select(*columns), "near-big")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    place = F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))  # the center goes to every block
    inside = big.withColumn("block", F.explode(place)).select(*columns, "block", F.col("block").alias("i"), F.col("block").alias("j"))
    first = written(_compared(held.unionByName(inside)), "near-links")

    labels = components(first.filter("blocks > 1").select("u", "v"))
    named = big.select("node", "family", "n").join(labels, "node", "left").select("node", "family", "n", F.coalesce("label", "node").alias("label"))
    centers = named.filter(F.col("node") == F.col("family")).select("family", F.col("label").alias("center"))
    sizes = named.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    total = big.count()
    marked = written(hot_join(written(named, "near-named"), written(centers.join(sizes, "family"), "near-centers"), ["family"], "members", total).select("node", "family", "n", "members", (F.col("label") == F.col("center")).alias("core")), "near-marked")
    side = lambda what, core: F.coalesce(F.sum(F.when(F.col("core") == core, what)), F.lit(0))
    split = marked.groupBy("family").agg(*[side(F.lit(1), c).alias(f"nodes_{c}") for c in (True, False)], *[side(F.col("n"), c).alias(f"shingles_{c}") for c in (True, False)], F.max("members").alias("members"))
    split = written(split.filter("nodes_false > 0").select("family", "members", _blocks("nodes_true", "shingles_true").alias("core_blocks"), _blocks("nodes_false", "shingles_false").alias("rest_blocks")), "near-splits")
    rows = hot_join(marked.select("node", "family", "core"), split, ["family"], "members", total)
    rows = rows.join(big.select("node", "n", "sig", "shingles"), "node").withColumn("blocks", F.col("core_blocks") + F.col("rest_blocks"))
    # the rest has the first blocks and meets all; the core has the others and meets the rest
    block = F.when(F.col("core"), F.col("rest_blocks") + F.pmod(F.xxhash64("node"), F.col("core_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest_blocks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("core"), F.col("rest_blocks")).otherwise(F.col("blocks")) - 1))
    rows = rows.withColumn("block", block).withColumn("other", other)
    rows = rows.select(*columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return first.unionByName(written(_compared(rows), "near-links"))


def near_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, hash, n, node) for each row of docs, (node, doc_id, copies) of the distinct sets, and (node, component, label) for the nodes that have a link.

    hash: of the text, copies: rows of the set, component: the smallest doc_id, label: the smallest node.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = written(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(_signatures, f"doc_id {kind}, hash long, n long, node binary, sig binary"), "near-signatures")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "near-nodes")
    sharing = written(sharing_nodes(nodes.drop("copies")), "near-sharing")

    # the prefix: the rarest c - MATCHES + 1 pairs; its coordinates also as a bit mask
    prefix = F.slice("shared", F.lit(1), F.size("shared") - MATCHES + 1)
    mask = F.aggregate(prefix, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["pair"], 32).cast("int"))))
    posts = sharing.select("node", "n", "sig", mask.alias("prefix"), F.explode(prefix).alias("x")).select("node", "n", "sig", "prefix", F.col("x.pair").alias("pair"))
    stats = written(posts.groupBy("pair").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("center")).filter("size > 1"), "near-postings")
    short = posts.join(stats.filter(F.col("size") <= SHORT).select("pair"), "pair").groupBy("pair").agg(F.collect_list(F.struct("node", "n", "sig", "prefix")).alias("members"))
    candidates = short.mapInArrow(_short_postings, "u binary, v binary")
    stars = posts.select("node", "pair").join(stats.filter(F.col("size") > SHORT), "pair").filter("node <> center").select(F.col("node").alias("u"), F.col("center").alias("v"))
    family = components(candidates.unionByName(stars)).withColumnRenamed("label", "family")
    family = written(family.join(nodes.select("node", "doc_id", "n", "sig"), "node"), "near-members")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).select("family", "members", _blocks("members", "shingles").alias("blocks"))
    family = written(hot_join(family, written(sizes, "near-sizes"), ["family"], "members", family.count()).drop("members"), "near-families")

    labels = components(family_links(docs, family).select("u", "v"))
    named = labels.join(nodes.select("node", "doc_id"), "node")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component"))
    return rows.select("doc_id", "hash", "n", "node"), nodes.select("node", "doc_id", "copies"), named.join(least, "label").select("node", "component", "label")


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, hash, n_shingles, component_id, kept, set; set: a key of the component, null for texts without words."""
    rows, nodes, linked = near_components(docs)
    known = nodes.join(linked, "node", "left").select("node", "copies", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("label", "node").alias("set"))
    out = hot_join(rows.filter("node is not null"), written(known, "near-known"), ["node"], "copies", rows.count())
    none = rows.filter("node is null").withColumn("component_id", F.col("doc_id")).withColumn("set", F.col("node"))
    out = out.drop("copies").unionByName(none)
    return out.select("doc_id", "hash", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "set")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    return judged(docs).drop("hash", "set")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group stays, one with the smallest doc_id; docs' columns stay. Rows that repeat its doc_id and text go, too.

    Rows are told apart by doc_id and text, so unlike texts under one doc_id, or under none, all stay.
    """
    each = written(judged(docs).groupBy("doc_id", "hash").agg(F.max("kept").alias("kept"), F.min("set").alias("set"), F.count(F.lit(1)).alias("copies")), "near-judged")
    # several texts of a group may stand under its smallest doc_id; without words, each doc_id and text is a group
    alone = [F.when(F.col("set").isNull(), F.col(c)) for c in ("doc_id", "hash")]
    place = F.row_number().over(Window.partitionBy("set", *alone).orderBy("hash"))
    kept = each.filter("kept").withColumn("place", place).filter("place > 1 or copies > 1").select("doc_id", "hash", (F.col("place") == 1).alias("kept"))
    verdict = written(kept.unionByName(each.filter("not kept").select("doc_id", "hash", "kept")), "near-verdicts")
    n = free_names(docs, "_maybe", "_kept", "_id", "_hash", "_text")
    rows = docs.withColumn(n["_text"], F.xxhash64("text"))
    rows = with_membership(rows, F.xxhash64("doc_id", n["_text"]), verdict.select(F.xxhash64("doc_id", "hash").alias("h")), n["_maybe"])
    sure = rows.filter(~F.col(n["_maybe"]))
    verdict = verdict.select(F.col("doc_id").alias(n["_id"]), F.col("hash").alias(n["_hash"]), F.col("kept").alias(n["_kept"]))
    same = F.col("doc_id").eqNullSafe(F.col(n["_id"])) & (F.col(n["_text"]) == F.col(n["_hash"]))
    rest = rows.filter(n["_maybe"]).join(verdict, same, "left").filter(F.coalesce(n["_kept"], F.lit(True)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return sure.select(*columns).unionByName(one_row(rest, ["doc_id", n["_text"]], docs.columns))
