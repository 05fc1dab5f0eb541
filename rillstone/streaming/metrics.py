"""Streaming operators: metrics, windows and sessions over files that keep arriving, dialogues as keyed state, and replays of budgeted thinking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 0) -> DataFrame:
    """A stream of the files below a path, as they appear."""
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def running_metrics(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Event-time windows with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(df: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: events that follow within the gap. Streams need ``late``."""
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """The result of a stream over all files that are there now, through an in-memory table: for small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def finished(stream: DataFrame, mode: str, checkpoint: str, result: str) -> DataFrame:
    """The result of a stream over all files that are there now, as a table: each batch is written to a folder of its own, and the last one counts in complete mode, all of them otherwise."""
    spark, schema = stream.sparkSession, stream.schema

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result}/{'last' if mode == 'complete' else f'batch={k}'}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{result}/last" if mode == "complete" else f"{result}/batch=*")


def budgeted(thought_end: int, separator: int, call: int, eos: int, budget: int = 1024, answer: int = 1024, most_calls: int = 6):
    """An Arrow-batched function over recorded ids: (thinking, answer, calls, ended).

    Phase one takes thinking tokens up to the budget; an end of thought before it becomes a separator and thinking goes on. Then the end of thought is set, and phase two
    takes answer tokens up to their own budget, the end id, or the cap on calls.
    """
    from pyspark.sql import types as T

    ids = T.ArrayType(T.LongType())
    kind = T.StructType([T.StructField("thinking", ids), T.StructField("answer", ids), T.StructField("calls", T.IntegerType()), T.StructField("ended", T.StringType())])

    def one(recorded):
        thinking: list[int] = []
        at = 0
        while at < len(recorded) and len(thinking) < budget:
            token, at = int(recorded[at]), at + 1
            if token == eos:
                at -= 1
                break
            thinking.append(separator if token == thought_end and len(thinking) + 1 < budget else token)
        if not thinking or thinking[-1] != thought_end:
            thinking.append(thought_end)
        said: list[int] = []
        calls = 0
        while at < len(recorded):
            token, at = int(recorded[at]), at + 1
            said.append(token)
            calls += token == call
            if token == eos:
                return thinking, said, calls, "end"
            if calls >= most_calls:
                return thinking, said, calls, "calls"
            if len(said) >= answer:
                return thinking, said, calls, "budget"
        return thinking, said, calls, "recorded"

    @F.pandas_udf(kind)
    def run(recorded: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one([] if r is None else r) for r in recorded], columns=["thinking", "answer", "calls", "ended"])

    return run


def boundary_turns(end: str = "<eos>", most: int = 6):
    """An Arrow-batched function over recorded tokens and replies: (move, end, reply) of each turn.

    A turn ends where a complete move does, wherever the tokens are cut; the next reply follows it. Turns end with the end token, the replies, or the cap.
    """
    import re

    from pyspark.sql import types as T

    from ..functions.moves import MOVE

    kind = T.ArrayType(T.StructType([T.StructField("move", T.StringType()), T.StructField("end", T.IntegerType()), T.StructField("reply", T.StringType())]))
    move = re.compile(MOVE)

    def walk(tokens, replies):
        out, word = [], ""
        for k, token in enumerate(tokens):
            if token == end or len(out) >= most:
                break
            *words, word = re.split(r"\s+", word + token)
            hit = next((w for w in (*words, word) if move.match(w)), None)
            if hit:
                out.append({"move": hit, "end": k + 1, "reply": replies[len(out)] if len(out) < len(replies) else None})
                word = ""
                if out[-1]["reply"] is None:
                    break
        return out

    @F.pandas_udf(kind)
    def run(tokens: pd.Series, replies: pd.Series) -> pd.Series:
        return pd.Series([walk([] if t is None else t, [] if r is None else r) for t, r in zip(tokens, replies, strict=True)])

    return run


def dialogue_steps(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Per dialogue: counts model turns up to a call cap; a reply without a call, or the cap, ends it. For applyInPandasWithState."""
    turns, done = state.get if state.exists else (0, False)
    for pdf in batches:
        for text in pdf.sort_values("turn")["text"]:
            if not done:
                turns += 1
                done = "<call_env>" not in text or turns >= 6
    state.update((turns, done))
    yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "done": [done]})


def dialogues(stream: DataFrame) -> DataFrame:
    return stream.groupBy("conv_id").applyInPandasWithState(dialogue_steps, "conv_id long, turns long, done boolean", "turns long, done boolean", "update", "NoTimeout")
