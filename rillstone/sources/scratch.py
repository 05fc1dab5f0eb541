"""Scratch tables: where lineage ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: dict[int, tuple[weakref.ref, str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without one, a temporary folder, in local mode only."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="rillstone-")
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is over: the folder belongs to the cluster's clean-up
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder: computed once, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/rillstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, key=id(out): _paths.pop(key, None)), path)
    return out


def discard(df: DataFrame) -> None:
    """Removes the table that ``written`` returned as df; no plan may read it any more."""
    if id(df) in _paths:
        _remove(df.sparkSession, _paths[id(df)][1])
