"""One stream into several sinks, each batch once in each, whatever fails in between.

Spark replays a batch that wasn't committed, with the same rows. A ledger holds a file for each sink and batch that was written; a replay
skips those. A sink that fails half-way is called again with the same batch, so it has to replace what it wrote: ``folder`` overwrites
the batch's own folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, int], None]


def folder(path: str, fmt: str = "parquet", **options) -> Sink:
    """A sink that keeps each batch in a folder of its own, so that a second try replaces the first."""

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/batch={k}")

    return put


class Ledger:
    """What has been written: a JSON file for each sink and batch, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, sink: str, batch: int) -> bool:
        path, fs = self._at(f"{sink}/{batch}.json")
        return fs.exists(path)

    def mark(self, sink: str, batch: int, metrics: dict) -> None:
        """Written under a hidden name, then renamed: a half-written mark is no mark."""
        (hidden, fs), (path, _) = self._at(f"{sink}/.{batch}.json"), self._at(f"{sink}/{batch}.json")
        out = fs.create(hidden, True)
        try:
            out.write(bytearray((json.dumps({"sink": sink, "batch": batch, "metrics": metrics}, default=str) + "\n").encode()))
        finally:
            out.close()
        if not fs.rename(hidden, path) and not fs.exists(path):
            raise OSError(f"no mark at {path}")

    def entries(self, metrics: str = "rows long") -> DataFrame:
        """(sink, batch, metrics) of all that is written."""
        return self.spark.read.schema(f"sink string, batch long, metrics struct<{metrics}>").json(f"{self.path}/*/[0-9]*.json")


def fan_out(stream: DataFrame, sinks: dict[str, Sink], ledger: Ledger, checkpoint: str, mode: str = "append", metrics: dict[str, Column] | None = None):
    """Starts the query that reads what is there now: each batch is computed once and goes to all sinks, in the order given.

    ``metrics`` are aggregates of a batch, observed while it is computed, and stand in the ledger beside its number of rows.
    """
    if bad := [s for s in sinks if not s or s.startswith(("_", ".")) or "/" in s]:
        raise ValueError(f"not the name of a sink: {bad}")
    wanted = [c.alias(n) for n, c in {"rows": F.count(F.lit(1)), **(metrics or {})}.items()]

    def put(batch: DataFrame, k: int) -> None:
        todo = [name for name in sinks if not ledger.done(name, k)]
        if not todo:
            return
        seen = Observation()
        kept = batch.observe(seen, *wanted).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            kept.write.format("noop").mode("overwrite").save()
            found = seen.get
            for name in todo:
                sinks[name](kept, k)
                ledger.mark(name, k, found)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
