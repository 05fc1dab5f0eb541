"""Streams of several batches: dialogues with timers against a plain replay, late rewards, sinks that resume."""

import datetime as dt
import random
import uuid

import pytest

from rillstone.sources.scratch import scratch_dir
from rillstone.streaming import dialogues as G
from rillstone.streaming import metrics as M

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
MESSAGE = "key string, turn long, model boolean, final boolean, size long, at timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def batches(spark, folder, rows, schema):
    """A file a batch, in order."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return stream.parquet(str(folder))


def finished(spark, stream, mode="append"):
    root = f"{scratch_dir(spark)}/rillstone/stream-{uuid.uuid4().hex}"
    return M.finished(stream, mode, root, f"{root}-result")


def taken(spark, folder, rows, **options):
    with G.rocksdb(spark):
        out = finished(spark, G.timed_dialogues(batches(spark, folder, rows, MESSAGE), **options)).collect()
    return sorted((r["key"], r["status"] is not None, r["turn"], r["start"], r["status"]) for r in out)


def test_dialogue_ends(spark, tmp_path):
    far = [("z", 0, True, True, 0, at(100_000))]  # moves the watermark on
    one = [
        ("end", 1, True, True, 5, at(7)), ("end", 0, False, False, 3, at(0)), ("end", 2, True, False, 1, at(9)),
        ("calls", 0, True, False, 1, at(0)), ("calls", 1, True, False, 1, at(1)), ("calls", 2, True, False, 1, at(2)),
        ("long", 0, False, False, 60, at(0)), ("long", 1, False, False, 60, at(1)), ("long", 2, False, False, 60, at(2)),
        ("gap", 0, True, False, 1, at(0)), ("gap", 2, True, False, 1, at(5)),
        ("slow", 0, True, False, 1, at(0)), ("slow", 1, True, False, 1, at(61)),
        ("edge", 0, True, False, 1, at(0)), ("edge", 1, True, True, 1, at(60)),
        ("none", 3, True, False, 1, at(0)),
        (None, 0, True, True, 1, at(0)), ("null", None, True, True, 1, at(0)), ("null", 0, True, True, 1, None),
        ("bare", 0, None, None, None, at(0)), ("twice", 0, True, True, 1, at(0)), ("twice", 0, True, True, 1, at(0)),
    ]
    out = taken(spark, tmp_path, [one, far], late="10 seconds", patience_s=60, most_calls=3, most_size=100)
    ends = {key: (turn, start, status) for key, ended, turn, start, status in out if ended}
    assert ends == {
        "end": (2, 8, "end"), "calls": (3, 3, "calls"), "long": (2, 120, "length"), "gap": (1, 1, "expired"), "slow": (1, 1, "expired"),
        "edge": (2, 2, "end"), "none": (0, 0, "expired"), "bare": (1, 0, "expired"), "twice": (1, 1, "end"), "z": (1, 0, "end"),
    }
    assert [(turn, start) for key, ended, turn, start, _ in out if key == "end" and not ended] == [(0, 0), (1, 3)]


def test_reply_in_a_later_batch_and_after_the_end(spark, tmp_path):
    rows = [
        [("a", 0, True, False, 1, at(0)), ("a", 2, True, True, 1, at(20)), ("b", 0, True, False, 1, at(0))],
        [("a", 1, False, False, 4, at(12)), ("c", 0, True, False, 1, at(50))],
        [("c", 1, True, False, 1, at(500))],
        [("d", 0, True, True, 1, at(510))],
        [("b", 1, True, True, 1, at(30)), ("a", 3, True, True, 1, at(520)), ("c", 2, True, True, 1, at(530))],  # b's reply is older than the watermark
        [("z", 0, True, True, 0, at(9_000))],
    ]
    ends = [r for r in taken(spark, tmp_path, rows, late="30 seconds", patience_s=60) if r[1]]
    assert ends == [("a", True, 3, 6, "end"), ("b", True, 1, 1, "expired"), ("c", True, 1, 1, "expired"), ("d", True, 1, 1, "end"), ("z", True, 1, 0, "end")]


def test_dialogues_dont_depend_on_batches(spark, tmp_path):
    rng, rows = random.Random(5), []
    for key in range(25):
        now = rng.randrange(100)
        for turn in range(rng.randrange(1, 8)):
            now += rng.choice([1, 20, 59, 60, 61, 90]) if turn else 0
            if rng.random() < 0.9 or turn == 0:
                rows.append((str(key), turn, turn % 2 == 1, rng.random() < 0.2, rng.randrange(40), at(now)))
    last = [("z", 0, True, True, 0, at(100_000))]
    rng.shuffle(rows)
    whole = taken(spark, tmp_path / "one", [rows, last], late="3600 seconds", patience_s=60, most_size=90)
    parts = taken(spark, tmp_path / "many", [*[rows[k::4] for k in range(4)], last], late="3600 seconds", patience_s=60, most_size=90)
    assert whole == parts and len({r[0] for r in whole if r[1]}) == 26
    assert {"expired", "end", "length"} <= {r[4] for r in whole}


def test_rewards_late_on_both_sides(spark, tmp_path):
    from rillstone.streaming.joins import late_rewards

    def stream(name, rows, schema):
        return batches(spark, tmp_path / name, rows, schema)

    rollouts = stream("a", [[(1, at(0)), (2, at(10)), (None, at(10)), (3, None), (6, at(0))], [(4, at(100)), (7, at(400))], [(8, at(410))], [(5, at(20)), (9, at(2000))], [(10, at(5000))]], "id long, at timestamp")
    rewards = stream("b", [[(1, at(60), 0.5), (1, at(61), 9.0), (6, at(0), 0.1)], [(4, at(90), 9.0), (7, at(401), 0.7)], [(8, at(411), 0.8)], [(2, at(30), 9.0), (4, at(101), 0.4), (9, at(2000), 0.9)], [(None, at(5000), 9.0)]], "id long, scored_at timestamp, reward double")
    with G.rocksdb(spark):
        out = finished(spark, late_rewards(rollouts, rewards, "id", "at", "scored_at", "50 seconds", "60 seconds")).collect()
    # 2's reward and rollout 5 come behind the watermark; 4's late one is behind it, too, and it has no other; 10 still waits
    assert sorted((r["id"], r["reward"]) for r in out if r["reward"] is not None) == [(1, 0.5), (6, 0.1), (7, 0.7), (8, 0.8), (9, 0.9)]
    assert sorted(r["id"] for r in out if r["reward"] is None) == [2, 4]


def test_sinks_resume_where_one_failed(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    from pyspark.sql import functions as F

    from rillstone.streaming import sinks as K

    rows = [[(k, float(i)) for i in range(n)] for k, n in enumerate([3, 5, 2])]
    stream = batches(spark, tmp_path / "in", rows, "k long, x double")
    calls, fail = [], [True]
    first, second = K.folder(str(tmp_path / "p")), K.folder(str(tmp_path / "j"), "json")

    def counted(batch, k):
        calls.append(k)
        first(batch, k)

    def shaky(batch, k):
        second(batch.limit(1) if k == 1 and fail[0] else batch, k)
        if k == 1 and fail[0]:
            raise OSError("gone")

    def run():
        K.fan_out(stream, {"table": counted, "log": shaky}, K.Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "c"), metrics={"most": F.max("x")}).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    assert calls == [0, 1]
    fail[0] = False
    run()
    run()
    assert calls == [0, 1, 2]
    wanted = sorted((k, x) for part in rows for k, x in part)
    assert sorted((r["k"], r["x"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == wanted
    assert sorted((r["k"], r["x"]) for r in spark.read.schema("k long, x double").json(str(tmp_path / "j")).collect()) == wanted
    marks = K.Ledger(spark, str(tmp_path / "ledger")).entries("rows long, most double").selectExpr("sink", "batch", "metrics.rows", "metrics.most").collect()
    assert sorted(tuple(m) for m in marks) == sorted((s, k, n, n - 1.0) for s in ("table", "log") for k, n in enumerate([3, 5, 2]))
    with pytest.raises(ValueError):
        K.fan_out(stream, {"a/b": counted}, K.Ledger(spark, str(tmp_path / "l2")), str(tmp_path / "c2"))


def test_state_is_written_without_reading_it_first(spark):
    from rillstone.streaming import dialogues

    before = {name: spark.conf.get(name, None) for name in dialogues.STORE}
    with dialogues.rocksdb(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
        assert spark.conf.get(dialogues.PROVIDER) == dialogues.ROCKSDB
    assert {name: spark.conf.get(name, None) for name in dialogues.STORE} == before
