"""Ball trees, cascading release and SimHash against brute force, odd rows and empty tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from rillstone.llm import centroids, release, simhash
from rillstone.llm.common import table
from rillstone.llm.queries import oracle_sql

SMALL = "/root/testdata/sf0.001"


# --- ball trees ---


def brute_clusters(rows, k=16, rounds=3):
    """(vec_id, cluster, distance) by comparing everything in Python integers; rows: (vec_id, embedding)."""
    kept = [(i, [int(np.floor(64 * min(max(float(x), -(2.0**21)), 2.0**21))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    name = lambda i: "" if i is None else str(i)
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{name(r[0])}".encode()).hexdigest(), name(r[0]), r[1]))[:k]
    middle = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(middle)), key=lambda c: (far(v, middle[c]), c)) for _, v in kept]
    for _ in range(rounds):
        label = assign()
        for c in set(label):
            own = [v for (_, v), x in zip(kept, label, strict=True) if x == c]
            middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((name(i), c, far(v, middle[c])) for (i, v), c in zip(kept, assign(), strict=True)), middle


def clustered(spark, rows, kind="long", **sizes):
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, label string, cluster string")
    labelled, middle = centroids.cluster(df.repartition(3), **sizes)
    return sorted(("" if r["vec_id"] is None else str(r["vec_id"]), r["cluster"], r["distance"]) for r in labelled.collect()), middle.tolist()


@pytest.mark.parametrize(("tree", "leaf"), [(1024, 32), (40, 1), (7, 3)])
def test_clusters_against_brute_force(spark, tree, leaf):
    rng = np.random.default_rng(tree)
    spread = rng.normal(size=(9, 64)) * 0.3
    rows = [(i, (spread[i % 9] + rng.normal(size=64) * (0.02 if i % 2 else 0.2)).tolist(), "x", "y") for i in range(160)]
    rows += [(500 + i, rows[0][1], "x", "y") for i in range(80)]  # a third of all vectors is one
    assert clustered(spark, rows, tree=tree, leaf=leaf) == brute_clusters([r[:2] for r in rows])


def test_clusters_of_odd_rows(spark):
    one = [0.5] * 64
    rows = [(1, None), (2, []), (3, [0.1] * 63), (4, [None] + [0.1] * 63), (5, [float("nan")] + [0.1] * 63), (6, [float("inf")] + [0.1] * 63), (7, one), (7, one), (None, [-0.001] * 64), (None, one), (8, [1e30] * 64), (9, [-1e300] * 64), (10, [-0.0] * 64)]
    want, middle = brute_clusters(rows)
    assert clustered(spark, [(*r, "x", "y") for r in rows]) == (want, middle)
    assert len(middle) == 7  # fewer vectors than centroids
    shown = centroids.report(spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, inertia string, v string")).collect()
    assert {r["inertia"] for r in shown} == {min((1 << 63) - 1, sum(d for *_, d in want))}


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64, "x", "y") for i in range(40)]  # many equal seeds
    got, middle = clustered(spark, rows, tree=8, leaf=2)
    assert (got, middle) == brute_clusters([r[:2] for r in rows])
    assert len({c for _, c, _ in got}) == 2


def test_no_vector_at_all(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert centroids.report(empty).count() == 0
    assert centroids.report(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_whole_balls_are_assigned():
    rng = np.random.default_rng(5)
    middle = (rng.normal(size=(4, 64)) * 500).astype(np.int64)
    v = np.concatenate([m + rng.integers(-3, 4, size=(100, 64)) for m in middle])
    order, bounds, radius, sums = centroids.build(v, 8)
    label, balls = centroids.nearest(v[order], bounds, radius, sums, middle)
    assert (label == ((v[order][:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(bounds[i, 1] - bounds[i, 0] for i, _ in balls) == 400 and len(balls) < 40  # no leaf is opened
    assert (sums[0] == v.sum(axis=0)).all()


def test_clusters_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    want = sorted(map(tuple, con.execute(oracle_sql()["op11_ball_tree_clusters"]).fetchall()))
    assert want == sorted(map(tuple, centroids.report(table(spark, SMALL, "embeddings")).collect()))


# --- cascading release ---


def brute_release(rows):
    """The contract, turn by turn; rows: (conv_id, turn, text)."""
    talks = {}
    for conv, turn, text in rows:
        talks.setdefault(conv, []).append((turn, zlib.crc32((text or "").encode())))
    out = []
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        ends, sent = [], []
        for p, (turn, crc) in enumerate(turns):
            h = lambda k: zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode())  # noqa: B023, E731
            start, back = 7 * p, h(0) % 3
            if back and p - back >= 0:
                status, at = ends[p - back]
                if status != "delivered":
                    ends.append(("blocked", None))
                    out.append((conv, turn, "blocked", 0, None, None, None, None))
                    continue
                start = max(start, at)
            faulty, at, status, a = h(1) % 101 < 35, start, "dead", 0
            while a < 5:
                a += 1
                if not (faulty and (at < 7 * p + h(2) % 101 or h(a + 2) % 3 == 0)):
                    status = "delivered"
                    break
                if a < 5:
                    at += 10 * 2 ** (a - 1)
            ends.append((status, at))
            row = [conv, turn, status, a, start, at, None, None]
            if status == "delivered":
                sent.append((at, p, crc, row))
            else:
                out.append(tuple(row))
        state = 0
        for n, (_, _, crc, row) in enumerate(sorted(sent, key=lambda s: s[:2]), 1):
            state += n * crc
            row[6:] = n, (state + (1 << 63)) % (1 << 64) - (1 << 63)
            out.append(tuple(row))
    return sorted(out, key=repr)


def replayed(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, text string, status string, p int")
    return sorted(map(tuple, release.report(df.repartition(parts)).collect()), key=repr)


def conversation(rng, conv, n):
    return [(conv, t, f"text {rng.random()}") for t in range(n)]


@pytest.mark.parametrize(("block", "run", "fan"), [(128, 65_536, 256), (4, 30, 2), (16, 40, 4)])
def test_release_against_brute_force(spark, monkeypatch, block, run, fan):
    """One conversation holds over a third of all rows; small blocks and runs make turns hang on several blocks before."""
    monkeypatch.setattr(release, "BLOCK", block)
    monkeypatch.setattr(release.sums_before, "__defaults__", (fan,))
    monkeypatch.setattr(release.numbered, "__defaults__", (run,))
    rng = random.Random(block)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randrange(1, 12))] + conversation(rng, 1000, 300)
    rng.shuffle(rows)
    assert replayed(spark, rows) == brute_release(rows)


def test_release_of_odd_rows(spark):
    rows = [(None, 0, "a"), (None, 1, None), (3, None, "b"), (3, None, "b"), (3, None, "c"), (3, 0, ""), (3, 0, None), (4, -5, "x"), (4, 9_000_000_000_000, "y" * 300_000), (5, 1, "é\x85"), (5, 1, "é\x85"), (None, None, None)]
    assert replayed(spark, rows) == brute_release(rows)
    rows = [(7, 1, f"t{i % 3}") for i in range(400)] + [(8, None, None)] * 200  # one turn, hundreds of times
    assert replayed(spark, rows) == brute_release(rows)


def test_release_of_no_turn(spark):
    out = release.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert out.count() == 0 and out.dtypes[4:] == [("first_at", "bigint"), ("last_at", "bigint"), ("release_no", "bigint"), ("state", "bigint")]


def test_state_wraps(spark):
    from pyspark.sql import functions as F

    big = [(1 << 63) - 1, 1 << 63, (1 << 64) + 5, 0, 3 * (1 << 64) - 1]
    df = spark.createDataFrame([(str(x),) for x in big], "x string").select(release._wrapped(F.col("x").cast("decimal(38,0)")).alias("y"))
    assert [r["y"] for r in df.collect()] == [(1 << 63) - 1, -(1 << 63), 5, 0, -1]


def test_attempts_table_equals_the_loop():
    made = release.attempts_table()
    for left in range(101):
        for mask in range(32):
            at, want = 0, 0
            for a in range(1, 6):
                if at >= left and not mask >> (a - 1) & 1:
                    want = a
                    break
                at += 10 * 2 ** (a - 1)
            assert made[left, mask] == want


def test_release_query(spark):
    turns = table(spark, SMALL, "conversations")
    rows = [(r["conv_id"], r["turn"], r["text"]) for r in turns.collect()]
    assert sorted(map(tuple, release.report(turns).collect()), key=repr) == brute_release(rows)


# --- SimHash ---


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{fp: smallest fp reachable} of distinct fingerprints."""
    label = {f: f for f in fps}
    changed = True
    near = {f: [g for g in fps if (f ^ g).bit_count() <= 4] for f in fps}
    while changed:
        changed = False
        for f in fps:
            least = min(label[g] for g in near[f])
            if least < label[f]:
                label[f], changed = least, True
    return label


def sketches(rng, n, clusters):
    """Fingerprints of chance, dense families, and chains of small steps."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(clusters):
        center = rng.getrandbits(64)
        out += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 8))) for _ in range(60)]
        for _ in range(12):
            center ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 4, 5])))
            out.append(center)
    return [*out, 0, (1 << 64) - 1, 15, 31]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("agree", "shard", "block"), [(None, 1024, 4096), (0, 16, 4096), (0, 1024, 30), (1, 8, 25), (2, 32, 4096), (3, 16, 40)])
def test_linked_fingerprints_against_brute_force(spark, agree, shard, block):
    rng = random.Random(shard + block)
    fps = sketches(rng, 150, 3)
    rows = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long").repartition(3)
    out = simhash.linked(rows, agree, shard, block).collect()
    label = brute_components(sorted(set(fps)))
    first = {}
    for i, f in enumerate(fps):
        first[label[f]] = min(i, first.get(label[f], i))
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: first[label[f]] for i, f in enumerate(fps)}


@pytest.mark.parametrize("agree", [0, 1, 2, 3, 4])
def test_a_tree_brings_near_fingerprints_together(agree):
    rng = np.random.default_rng(agree)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    met = set()
    for bits, radius in simhash.metrics(agree)[: 8 if agree == 4 else None]:
        tree = simhash.grow(a, bits, radius, 5)
        left, right = ({(int(r), int(x)) for r, x in zip(*tree.visits(side), strict=True)} for side in (a, b))
        met |= {r for r, _ in left & right}
        if radius == 0:
            assert len(left) == len(a)  # no search crosses a boundary
    assert agree == 4 or met == set(range(300))


def test_links_leave_a_task_as_a_forest():
    center = 0x0123456789ABCDEF
    near = np.unique(np.array([center ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)], dtype=np.uint64))  # 2,016 fingerprints, all within 4 of each other
    assert len(simhash.links(near)) == len(near) - 1
    assert len(simhash.links(near[:1000], near[1000:])) == len(near) - 1


def test_fingerprints_against_brute_force(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One TWO three", "a b c d", "É\x85ü ſ K a", "x " * 1000, *(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 300))) for _ in range(60))]
    for window in (1 << 20, 7, 60):
        monkeypatch.setattr(simhash, "WINDOW", window)
        assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_fingerprints_equal_the_engines_hash(spark):
    """A text of one shingle has the bits of Spark's own xxhash64, whose seed is 42."""
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert signed(simhash.fingerprint("A b\tC d")) == row["h"]


def test_simhash_of_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "same text here now"), (3, "same text here now"), (4, "SAME text  here now"), (None, "same text here now"), (None, "no id at all for this"), (5, "word " * 40_000), (6, "é\x85ü")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, fp string, component_id string, shard int")
    got = sorted(map(tuple, simhash.report(df.repartition(3)).collect()), key=repr)
    zero = "0" * 16
    hexed = lambda t: f"{brute_fingerprint(t):016x}"
    want = [(i, zero, 0) for i in (0, 1, 2)] + [(i, hexed(rows[3][1]), 3) for i in (3, 3, 4, None)] + [(None, hexed(rows[7][1]), None), (5, hexed(rows[8][1]), 5), (6, hexed(rows[9][1]), 6)]
    assert got == sorted(want, key=repr)
    assert simhash.report(df.limit(0)).count() == 0


def test_simhash_query(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    label, first = brute_components(sorted(set(fps.values()))), {}
    for i, f in fps.items():
        first[label[f]] = min(i, first.get(label[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(table(spark, SMALL, "documents")).collect()}
    assert got == {i: (f"{f:016x}", first[label[f]]) for i, f in fps.items()}
