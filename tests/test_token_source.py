"""Token files as a data source: round trips, byte ranges, commits that fail."""

import os

import numpy as np
import pytest

from rillstone.sources import token_source as S

F = pytest.importorskip("pyspark.sql.functions")
ROWS = "s string, k int, ids array<bigint>"


def names(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, files in os.walk(root) for n in files)


def test_round_trip_in_byte_ranges(spark, tmp_path):
    root = str(tmp_path / "t")
    want = {"a": list(range(1000)), "b/ü": [2**32 - 1, 0, 7], "c": [5] * 37}
    rows = [(s, k, ids[k * 10 : k * 10 + 10]) for s, ids in want.items() for k in range(-(-len(ids) // 10))] + [("none", 0, []), ("none", 1, None), ("a", 500, None)]
    S.write_tokens(spark.createDataFrame(rows, ROWS).repartition(5), "s", "k", "ids", root)
    assert np.load(f"{root}/a.npy").dtype == np.uint32 and np.load(f"{root}/a.npy").tolist() == want["a"]
    assert names(root) == ["a.npy", "b%2F%C3%BC.npy", "c.npy"]
    for split, chunk in ((1 << 24, 1 << 16), (64, 10), (7, 100)):
        df = S.read_tokens(spark, root, split, chunk)
        if split == 64:
            assert df.rdd.getNumPartitions() == -(-1040 // 64)
        got = {}
        for r in sorted(df.collect(), key=lambda r: (r["path"], r["at"])):
            assert len(r["ids"]) <= chunk and len(got.setdefault(r["path"], [])) == r["at"]
            got[r["path"]] += r["ids"]
        assert sorted(got.values()) == sorted(want.values())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    S.write_tokens(spark.createDataFrame([("old", 0, [1])], ROWS), "s", "k", "ids", root)
    for bad in ([-1], [1 << 32], [None]):
        with pytest.raises(Exception, match="holds an id"):
            S.write_tokens(spark.createDataFrame([*((f"s{i}", 0, [1, 2]) for i in range(20)), ("s3", 1, bad)], ROWS), "s", "k", "ids", root)
        assert names(root) == ["old.npy"] and not [d for d in os.listdir(root) if d.startswith("_")]
    with pytest.raises(Exception, match="no shard"):
        S.write_tokens(spark.createDataFrame([(None, 0, [1, 2])], ROWS), "s", "k", "ids", root)


def test_a_shard_is_never_overwritten_by_accident(spark, tmp_path):
    root = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 0, [1])], ROWS)
    S.write_tokens(one, "s", "k", "ids", root)
    with pytest.raises(Exception, match="exists"):
        S.write_tokens(spark.createDataFrame([("a", 0, [2]), ("b", 0, [3])], ROWS), "s", "k", "ids", root)
    assert names(root) == ["a.npy"] and np.load(f"{root}/a.npy").tolist() == [1]
    S.write_tokens(spark.createDataFrame([("b", 0, [3])], ROWS), "s", "k", "ids", root)
    S.write_tokens(spark.createDataFrame([("c", 0, [4])], ROWS), "s", "k", "ids", f"file://{root}", overwrite=True)
    assert names(root) == ["c.npy"]


def test_files_of_other_writers(spark, tmp_path):
    (tmp_path / "shard_1").mkdir()
    np.save(tmp_path / "shard_1" / "x.npy", np.array([3, 4], dtype=np.uint16))
    np.save(tmp_path / "y.npy", np.array([], dtype=np.int64))
    (tmp_path / "_temporary-1").mkdir()
    np.save(tmp_path / "_temporary-1" / "z.npy", np.array([9], dtype=np.uint32))
    assert [(r["at"], r["ids"]) for r in S.read_tokens(spark, str(tmp_path)).collect()] == [(0, [3, 4])]
    np.save(tmp_path / "bad.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="flat array"):
        S.read_tokens(spark, str(tmp_path)).collect()


def test_no_file_at_all(spark, tmp_path):
    assert S.read_tokens(spark, str(tmp_path)).count() == 0


def test_small_inputs_are_cut_for_all_cores(spark, tmp_path):
    root = f"{tmp_path}/t"
    S.write_tokens(spark.range(4).selectExpr("CAST(id DIV 2 AS STRING) AS s", "id AS k", "sequence(0, 199999) AS ids"), "s", "k", "ids", root)
    df = S.read_tokens(spark, root)
    assert df.rdd.getNumPartitions() >= 8
    rows = df.selectExpr("path", "posexplode(ids) AS (k, id)", "at").groupBy("path").agg({"id": "sum", "*": "count"}).collect()
    assert [(r["count(1)"], r["sum(id)"]) for r in rows] == [(400_000, 2 * sum(range(200_000)))] * 2


def test_names_are_read_once_a_file(spark):
    from rillstone.plans.corpus_queries import token_files

    lines = token_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda word: [k for k, x in enumerate(lines) if word in x]
    assert len(at("regexp_extract")) == 1 and at("regexp_extract") <= at("Aggregate") < at("Generate")
