"""Flat token files (``.npy`` of unsigned 32-bit ids, one a shard) as a data source of Spark: ``format("token_files")``.

Reading: the driver lists the files and reads their headers; a partition is a set of byte ranges of about ``split`` ids, so a
large file is read by many tasks and small ones share a task. Rows are (path, at, ids): up to ``chunk`` ids from
position ``at`` of a file.

Writing: each task writes whole shards into a folder of the job below the root, and the commit moves them to their names once all
tasks are through. A task that fails or runs twice leaves nothing. A shard that exists is never overwritten, unless the mode is
overwrite. Folders are whatever ``pyarrow.fs`` opens by its address: local or mounted folders, object stores, HDFS.
"""

from __future__ import annotations

import fnmatch
import math
import posixpath
import urllib.parse
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "token_files"
#: Ids of a partition and of a row, about and at most.
SPLIT, CHUNK = 1 << 24, 1 << 16
_SCHEMA = "path string, at bigint, ids array<bigint>"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path on it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def _header(system: fs.FileSystem, path: str) -> tuple[int, int, str]:
    """(offset of the data, ids, type) of a file."""
    with system.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, kind = read(f)
        if len(shape) != 1 or kind.kind not in "iu":
            raise ValueError(f"{path} doesn't hold a flat array of whole numbers")
        return f.tell(), shape[0], kind.str


@dataclass
class Ranges(InputPartition):
    """(path, place of the first byte, position of the first id, ids, type) of the ranges of one task."""

    value: tuple[tuple[str, int, int, int, str], ...]


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.pattern = options.get("pattern", "*.npy")
        self.split, self.chunk, self.tasks = int(options.get("split", SPLIT)), int(options.get("chunk", CHUNK)), int(options.get("tasks", 1))

    def partitions(self) -> list[Ranges]:
        system, top = opened(self.root)
        inside = lambda p: posixpath.relpath(p, top).split("/")
        found = [i.path for i in system.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file and fnmatch.fnmatch(i.base_name, self.pattern) and not any(x[0] in "_." for x in inside(i.path))]
        found.sort()
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(lambda path: _header(system, path), found))
        size = min(self.split, max(CHUNK, math.ceil(sum(n for _, n, _ in headers) / self.tasks))) if self.tasks > 1 else self.split
        out, now, room = [], [], size
        for path, (offset, n, kind) in zip(found, headers, strict=True):
            at = 0
            while at < n:
                take = min(room, n - at)
                now.append((path, offset + at * np.dtype(kind).itemsize, at, take, kind))
                at, room = at + take, room - take
                if not room:
                    out.append(Ranges(tuple(now)))
                    now, room = [], size
        return [*out, Ranges(tuple(now))] if now or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        for path, place, at, n, kind in partition.value:
            with system.open_input_file(path) as f:
                f.seek(place)
                while n:
                    ids = np.frombuffer(f.read(min(n, self.chunk) * np.dtype(kind).itemsize), dtype=kind).astype(np.int64)
                    if not len(ids):
                        raise ValueError(f"{path} ends before its header says")
                    row = [pa.array([path]), pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))]
                    yield pa.RecordBatch.from_arrays(row, names=["path", "at", "ids"])
                    at, n = at + len(ids), n - len(ids)


@dataclass
class Written(WriterCommitMessage):
    """(shard, file, ids) of the files of one task."""

    files: list[tuple[str, str, int]]


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.replace = options["path"], overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = opened(self.root)
        files, shard, held = [], None, []

        def close() -> None:
            ids = np.concatenate(held) if held else np.zeros(0, dtype=np.int64)
            if not len(ids):
                return  # a shard without tokens has no file
            if ids.min() < 0 or ids.max() >= 1 << 32:
                raise ValueError(f"shard {shard} holds an id that isn't an unsigned 32-bit number")
            path = posixpath.join(top, self.job, f"{uuid.uuid4().hex}.npy")
            system.create_dir(posixpath.dirname(path), recursive=True)
            with system.open_output_stream(path) as f:
                np.lib.format.write_array(f, ids.astype("<u4"), version=(1, 0))
            files.append((shard, path, len(ids)))

        for batch in iterator:
            names, lists = batch.column("shard"), batch.column("ids")
            if names.null_count:
                raise ValueError("a row has no shard")
            for k, name in enumerate(names.to_pylist()):
                if name != shard:
                    close()
                    shard, held = name, []
                if lists[k].is_valid:
                    if lists[k].values.null_count:
                        raise ValueError(f"shard {shard} holds an id that is null")
                    held.append(np.asarray(lists[k].values, dtype=np.int64))
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = opened(self.root)
        files = [f for m in messages if m for f in m.files]
        try:
            names = {shard: posixpath.join(top, f"{urllib.parse.quote(shard, safe='')}.npy") for shard, _, _ in files}
            if len(names) < len(files):
                raise ValueError("a shard's rows have to follow each other in one task")
            there = [i.path for i in system.get_file_info(list(names.values())) if i.is_file] if names else []
            if there and not self.replace:
                raise ValueError(f"{there[0]} exists")
            old = [i.path for i in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.is_file and i.base_name.endswith(".npy")] if self.replace else []
            for path in old:
                system.delete_file(path)
            for shard, path, _ in files:
                system.move(path, names[shard])
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, top = opened(self.root)
        job = posixpath.join(top, self.job)
        if system.get_file_info(job).type == fs.FileType.Directory:
            system.delete_dir(job)


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), overwrite)


def read_tokens(spark: SparkSession, root: str, split: int | None = None, chunk: int = CHUNK, pattern: str = "*.npy") -> DataFrame:
    """(path, at, ids): the ids of the files below root, in rows of up to ``chunk``. Without a ``split``, small inputs are cut finer, so that all cores have ranges to read."""
    spark.dataSource.register(TokenFiles)
    tasks = 1 if split else 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(NAME).option("split", split or SPLIT).option("tasks", tasks).option("chunk", chunk).option("pattern", pattern).load(root)


def write_tokens(df: DataFrame, shard: str, order: str, ids: str, root: str, overwrite: bool = False) -> None:
    """One file a shard, its rows' ids by ``order``. A shard is held by one task, so it should be bounded, as those of ``greedy_shards`` are."""
    df.sparkSession.dataSource.register(TokenFiles)
    rows = df.select(F.col(shard).cast("string").alias("shard"), F.col(order).alias("order"), F.col(ids).cast("array<bigint>").alias("ids"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "order").select("shard", "ids")
    rows.write.format(NAME).mode("overwrite" if overwrite else "append").save(root)
