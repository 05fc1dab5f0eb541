"""Loaders: files found by step, suffix or pattern, read with their columns checked; token files; memos; retrieval."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import csv_table


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything but empty files."""
    at, fs = _fs(spark, path)
    return bool(fs.exists(at)) and fs.getContentSummary(at).getLength() > 0


def listed(spark: SparkSession, specs: str | Iterable[str], suffixes: tuple[str, ...] = (".jsonl", ".json")) -> list[str]:
    """Files of file, folder or glob specifications, sorted, each once; a folder gives its files with the suffixes."""
    found: set[str] = set()
    for spec in [specs] if isinstance(specs, str) else specs:
        at, fs = _fs(spark, spec)
        for status in fs.globStatus(at) or []:
            if status.isDirectory():
                found |= {str(s.getPath()) for s in fs.listStatus(status.getPath()) if s.isFile() and str(s.getPath()).endswith(suffixes)}
            else:
                found.add(str(status.getPath()))
    return sorted(found)


def first_turn_scores(spark: SparkSession, path: str, columns: tuple[str, ...], turn: str = "turn", source: str = "data_source", prefix: str = "test_B") -> DataFrame | None:
    """The columns of the first turns of sources with a prefix; None without data. Columns and filters are pushed into the scan."""
    if not exists(spark, path):
        return None
    from ..operators.stages import first_turns

    return first_turns(spark.read.parquet(path).select(*columns), turn, source, prefix)


def write_text_column(df: DataFrame, column: str, path: str) -> None:
    """One column as lines of CSV without a header, NULL and blank rows removed, quoted where a line needs it."""
    clean = F.trim(F.col(column))
    df.select(clean.alias(column)).filter(clean != "").write.option("escape", '"').csv(path)


def _token_batches(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    import io

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.load(io.BytesIO(content.as_py())).astype(np.int64)
            ids = ids if most is None else ids[:most]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["path", "ids"])


def token_files(spark: SparkSession, root: str, most: int | None = None, pattern: str = "*.npy") -> DataFrame:
    """(path, ids) of the token files below a folder, the ids cut at ``most``. A task per group of files; order is the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")
    return files.mapInArrow(lambda b: _token_batches(b, most), "path string, ids array<bigint>")


def files_in_order(spark: SparkSession, root: str, pattern: str = "*.npy") -> list[str]:
    """Paths below ``root``/shard_*/ by folder and name; a listing."""
    return listed(spark, f"{root}/shard_*/{pattern}", ())


def concatenated(spark: SparkSession, paths: list[str], most: int = 0, key: str | None = None, seed: int = 0) -> DataFrame:
    """Parquet files as one table; columns that a file lacks are NULL. ``most`` > 0 keeps so many rows, by seeded hashes of the key or the first by it."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None or not most:
        return out
    if key is None:
        raise ValueError("a sample needs a key")
    from ..operators.batch import sample_n

    return sample_n(out, key, most, seed)


def short_prompts(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows whose prompt has at most ``most`` tokens; a prompt that couldn't be tokenised counts as too long."""
    return df.filter(F.coalesce(F.size(tokens), F.lit(most + 1)) <= F.lit(most)).filter(tokens.isNotNull())


def nested(df: DataFrame, path: str, default: object = None) -> Column:
    """A column at a dot path through structs and maps; the default where it is missing or NULL."""
    from pyspark.sql import types as T

    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(default)
    at, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for name in rest:
        if isinstance(kind, T.StructType) and name in kind.names:
            at, kind = at.getField(name), kind[name].dataType
        elif isinstance(kind, T.MapType):
            at, kind = F.try_element_at(at, F.lit(name)), kind.valueType
        else:
            return F.lit(default)
    return F.coalesce(at, F.lit(default)) if default is not None else at


def unwrapped(df: DataFrame, column: str) -> Column:
    """The only element of an array of one; an array of more is an error; other columns as they are."""
    from pyspark.sql import types as T

    c = F.col(column)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        return c
    return F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.raise_error(F.lit(f"{column} holds more than one value")).cast(df.schema[column].dataType.elementType))


def conversations(spark: SparkSession, paths: list[str], messages: str = "messages", optional: tuple[str, ...] = ("tools", "enable_thinking")) -> DataFrame:
    """Messages with the optional columns where the files have them, and NULL where they don't."""
    df = concatenated(spark, paths)
    return df.select(messages, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional])


def by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its file's suffix: Parquet, CSV or JSON lines."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return csv_table(spark, path, schema)
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(schema).json(path)
    raise ValueError(f"unknown suffix: {path}")


def first_of(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of the tables that exists."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    return None


def memo(spark: SparkSession, root: str, version: int, keys: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once for a version and its keys, and read from then on. A half-written one has no success mark and is made again."""
    path = "/".join([root.rstrip("/"), f"v{version}", *keys])
    if not exists(spark, f"{path}/_SUCCESS") and not _marked(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _marked(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(at))


def numbered_folders(spark: SparkSession, root: str, prefix: str = "global_step_") -> list[tuple[int, str]]:
    """(number, path) of the folders named prefix and number, by number."""
    at, fs = _fs(spark, root)
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        tail = status.getPath().getName().removeprefix(prefix)
        if status.isDirectory() and status.getPath().getName().startswith(prefix) and tail.isdigit():
            found.append((int(tail), str(status.getPath())))
    return sorted(found)


def latest_folder(spark: SparkSession, root: str, prefix: str = "global_step_", tracker: str = "latest_checkpointed_iteration.txt") -> str | None:
    """The folder that a tracker file names, else the one with the highest number; None without any."""
    folders = dict(numbered_folders(spark, root, prefix))
    if exists(spark, f"{root}/{tracker}"):
        number = int(spark.read.text(f"{root}/{tracker}").first()[0].strip())
        return folders.get(number)
    return folders[max(folders)] if folders else None


def outdated_folders(spark: SparkSession, root: str, keep: int, prefix: str = "global_step_") -> list[str]:
    """What is to be removed so that the ``keep`` highest numbers stay. Only listed: removing is the caller's decision."""
    folders = numbered_folders(spark, root, prefix)
    return [p for _, p in folders[: max(0, len(folders) - keep)]]


def with_responses(prompts: DataFrame, responses: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Prompts with the list of their responses in order; NULL-safe: a prompt without any gets an empty list."""
    lists = responses.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]).alias("responses"))
    return prompts.join(lists, key, "left").withColumn("responses", F.coalesce("responses", F.array().cast("array<string>")))


def staged_name(path: str) -> str:
    """A local name for a remote file: its hash as folder, so that files of one name don't meet."""
    import hashlib

    return f"{hashlib.md5(path.encode()).hexdigest()}/{path.rstrip('/').rsplit('/', 1)[-1]}"


def staged(spark: SparkSession, source: str, root: str) -> str:
    """A copy of a remote file or folder below ``root``, made again if its size differs; returns its path."""
    target = f"{root.rstrip('/')}/{staged_name(source)}"
    at, fs = _fs(spark, source)
    to, tofs = _fs(spark, target)
    size = fs.getContentSummary(at).getLength()
    if not tofs.exists(to) or tofs.getContentSummary(to).getLength() != size:
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, tofs, to, False, True, spark.sparkContext._jsc.hadoopConfiguration())
        if tofs.getContentSummary(to).getLength() != size:
            raise OSError(f"{source} wasn't copied whole")
    return target


def search(queries: list[str], url: str, top: int = 3, attempts: int = 5, wait: float = 1.0, send: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> list[list[dict]]:
    """Answers of a retrieval service to a batch of queries; server errors are tried again after growing pauses, others fail at once."""
    body = json.dumps({"queries": queries, "topk": top, "return_scores": True}).encode()
    send = send or (lambda data: urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}, method="POST"), timeout=30).read())
    for attempt in range(attempts):
        try:
            return json.loads(send(body))["result"]
        except urllib.error.HTTPError as e:
            if e.code not in (500, 502, 503, 504) or attempt == attempts - 1:
                raise
        except urllib.error.URLError:
            if attempt == attempts - 1:
                raise
        sleep(wait * (attempt + 1))
    return []


def searched(df: DataFrame, key: str, query: str, url: str, top: int = 3, size: int = 64, rate: float | None = None, send: Callable | None = None) -> DataFrame:
    """(key, documents) for a column of queries: each task sends its own batches, at most ``rate`` a second."""
    kind = dict(df.dtypes)[key]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                began = time.monotonic()
                found = search(part.column(1).to_pylist(), url, top, send=send)
                docs = [[d["document"]["contents"] for d in answer] for answer in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(docs, pa.list_(pa.string()))], names=[key, "documents"])
                if rate:
                    time.sleep(max(0.0, 1 / rate - (time.monotonic() - began)))

    return df.select(key, query).mapInArrow(ask, f"{key} {kind}, documents array<string>")


def passages(documents: Column) -> Column:
    """Documents as one text: the first line of each is its title."""
    one = lambda c, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(c, "\n", 1), F.lit(")\n"), F.when(F.contains(c, F.lit("\n")), F.substring(c, F.locate("\n", c) + 1, F.length(c))).otherwise(""))
    return F.trim(F.array_join(F.transform(documents, one), "\n\n"))
