"""Scans and sinks: Parquet, CSV, JSON lines, nested JSON, text, token arrays, sharded JSON, metric tables.

Schemas are declared; nothing is inferred from data.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a puzzle table.
PUZZLES = "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, NbPlays int, Popularity int, Themes string, GameUrl string"
ROLLOUTS = "input string, output string, data_source string, extracted_moves string, target_moves string, ground_truth string, score double, outcome_score double, step int"


def parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a path; folders that look like partitions add no columns."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0, codec: str = "zstd") -> None:
    df.write.option("compression", codec).option("maxRecordsPerFile", rows_per_file).parquet(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and cells over many lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns that exist, in the order given; arrays as JSON."""
    kinds = dict(df.dtypes)
    cols = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns if c in kinds]
    df.select(*cols).write.option("header", True).option("escape", '"').csv(path)


def json_lines(spark: SparkSession, path: str, schema: str = ROLLOUTS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines, a folder a step."""
    df.write.partitionBy(step).json(path)


def nested_results(spark: SparkSession, path: str, schema: str, field: str, prompt: str) -> DataFrame:
    """Rows of ``results`` of whole-file JSON documents: the prompt and the field at a dot path; rows where either is empty go, unreadable files give none."""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    rows = docs.select(F.explode("results").alias("r")).select(F.col(f"r.{prompt}").alias("prompt"), F.col(f"r.{field}").alias("response"))
    return rows.filter((F.trim("prompt") != "") & (F.trim("response") != ""))


def mixed_tables(spark: SparkSession, paths: list[str], schema: str, column: str) -> DataFrame:
    """One column of CSV and Parquet files; other suffixes and tables without the column are skipped, NULLs go, values are distinct."""
    found = []
    for p in paths:
        df = csv_table(spark, p, schema) if p.endswith(".csv") else spark.read.parquet(p) if p.endswith(".parquet") else None
        if df is not None and column in df.columns:
            found.append(df.select(column))
    out = spark.createDataFrame([], f"{column} string") if not found else found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.filter(F.col(column).isNotNull()).distinct()


def steps_in(spark: SparkSession, root: str) -> DataFrame:
    """(path, step) of the files below a folder, the step read from a folder named step_<n>; sorted by number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").filter("length > 0")
    return files.withColumn("step", F.regexp_extract("path", r"step_(\d+)", 1).try_cast("int")).filter("step is not null").orderBy("step", "path")


def split_games(text: Column) -> Column:
    """Concatenated game records, one array element a game."""
    return F.split(text, r"\n(?=\[Event )")


def token_table(df: DataFrame, ids: str, path: str) -> None:
    """Token arrays as a table (shard, pos-ordered int array): the engine's own form of flat token files."""
    df.select("shard", F.transform(ids, lambda x: x.cast("int")).alias("ids")).write.parquet(path)


def write_sharded_json(df: DataFrame, path: str, rows: int) -> None:
    df.write.option("maxRecordsPerFile", rows).json(path)


def post_in_batches(ids: list[str], url: str, size: int = 200, retries: int = 2, send: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[bytes]:
    """Answers to POSTs of ``size`` ids each. A 429 waits as told, a 5xx backs off with jitter; both at most ``retries`` times.

    Meant for mapInPandas over partitions of ids, so that each executor sends its own.
    """
    send = send or (lambda body: urllib.request.urlopen(urllib.request.Request(url, body.encode(), method="POST"), timeout=60).read())
    for at in range(0, len(ids), size):
        body = ",".join(ids[at : at + size])
        for attempt in range(retries + 1):
            try:
                yield send(body)
                break
            except urllib.error.HTTPError as e:
                if attempt == retries or (e.code != 429 and e.code < 500):
                    raise
                wait = float(e.headers.get("Retry-After", 1)) if e.code == 429 and e.headers else 2.0**attempt
                sleep(wait + random.random() * 0.1)


def log_metrics(df: DataFrame, path: str, keys: list[str]) -> None:
    """A wide metrics table in long form (keys, metric, value), appended."""
    names = [c for c in df.columns if c not in keys]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select(*keys, "x.*")
    long.write.mode("append").parquet(path)


def flat_keys(nested: dict, separator: str = "/", prefix: str = "") -> dict:
    """A nested dict as one level with joined keys."""
    out = {}
    for k, v in nested.items():
        name = f"{prefix}{separator}{k}" if prefix else str(k)
        out |= flat_keys(v, separator, name) if isinstance(v, dict) else {name: v}
    return out


def manifest(text: str) -> list[dict]:
    """Rows of a blank-separated manifest with a header line; # starts a comment."""
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return [dict(zip(lines[0], row, strict=True)) for row in lines[1:]] if lines else []


def decode_truth(text: str):
    """JSON, else a Python literal, else the text."""
    import ast

    for parse in (json.loads, ast.literal_eval):
        try:
            return parse(text)
        except (ValueError, SyntaxError):
            pass
    return text
