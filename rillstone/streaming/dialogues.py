"""Dialogues as keyed state with event timers: messages come in any order, replies may be late or never come.

A dialogue starts with turn 0 and takes its turns in order. It ends with the first of
  end      a model turn that is final,
  calls    the cap on model turns,
  length   the cap on the dialogue's length,
  expired  the next turn isn't there once the watermark is past the last taken turn (for turn 0: the first that waits) by more than the patience;
           a turn dated later than that ends it in the same way, so the end doesn't depend on batches.
What waits for a turn before it is kept in state, a row a turn, and goes with the dialogue; a dialogue that ended is remembered for a while, so
that stragglers don't open it anew. Rows older than the watermark of the batch before are dropped by Spark, repeats of a turn by the first that is seen (in a batch: the least by time, size and flags).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPTION = "spark.sql.streaming.stateStore.rocksdb"
STORE = {PROVIDER: ROCKSDB, f"{_OPTION}.trackTotalNumberOfRows": "false", f"{_OPTION}.changelogCheckpointing.enabled": "true"}
#: status is null for a taken turn and set for the row that ends a dialogue, whose turn is the number of turns taken.
OUTPUT = "key string, turn long, model boolean, start long, size long, status string"


class Dialogue(StatefulProcessor):
    """Input per key: turn, model, final, size, at_ms. Output: OUTPUT without the time of writing, ends once a dialogue."""

    def __init__(self, patience_ms: int, most_calls: int, most_size: int, memory_ms: int):
        self.patience, self.calls, self.size, self.memory = patience_ms, most_calls, most_size, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "next long, calls long, size long, due long, parked long, over boolean")
        self.waiting = handle.getMapState("waiting", "turn long", "model boolean, final boolean, size long, at long")

    def close(self) -> None:
        pass

    def _due(self, old: int, new: int) -> int:
        """One timer a key: the old one goes, the new one comes."""
        if old != new:
            if old >= 0:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return new

    def _end(self, key, status: str, taken: int, size: int, due: int, parked: int, now: int) -> dict:
        for turn in [t[0] for t in self.waiting.keys()] if parked else ():
            self.waiting.removeKey((turn,))
        self.known.update((taken, 0, size, self._due(due, now + self.memory), 0, True))
        return {"key": key[0], "turn": taken, "model": None, "start": size, "size": 0, "status": status}

    def _state(self) -> tuple:
        return tuple(self.known.get()) if self.known.exists() else (0, 0, 0, -1, 0, False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Turns that can be taken at once never touch the map of what waits; a batch of rows is held, not a dialogue."""
        turn, calls, size, due, parked, over = self._state()
        out, status, last, first = [], None, None, None
        for pdf in rows:
            if over or status:
                continue
            fresh: dict[int, tuple] = {}
            for r in pdf.sort_values(["turn", "at_ms", "size", "model", "final"]).itertuples():
                if r.turn >= turn:
                    fresh.setdefault(int(r.turn), (bool(r.model), bool(r.final), int(r.size), int(r.at_ms)))
            while status is None:
                if parked and self.waiting.containsKey((turn,)):
                    message, parked = self.waiting.getValue((turn,)), parked - 1
                    self.waiting.removeKey((turn,))
                    fresh.pop(turn, None)
                elif turn in fresh:
                    message = fresh.pop(turn)
                else:
                    break
                model, final, length, at = message
                if turn and at > (due if last is None else last + self.patience):
                    status = "expired"
                    break
                out.append({"key": key[0], "turn": turn, "model": model, "start": size, "size": length, "status": None})
                turn, calls, size, last = turn + 1, calls + model, size + length, at
                status = "end" if model and final else "calls" if calls >= self.calls else "length" if size >= self.size else None
            for place, message in fresh.items() if status is None else ():
                if not (parked and self.waiting.containsKey((place,))):
                    self.waiting.updateValue((place,), message)
                    parked, first = parked + 1, message[3] if first is None else min(first, message[3])
        if over:
            return
        if status:
            out.append(self._end(key, status, turn, size, due, parked, max(timerValues.getCurrentWatermarkInMs(), last or 0, first or 0)))
        else:
            if last is not None:
                due = self._due(due, last + self.patience)
            elif turn == 0 and first is not None:
                due = self._due(due, first + self.patience if due < 0 else min(due, first + self.patience))
            self.known.update((turn, calls, size, due, parked, False))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn, _, size, due, parked, over = self._state()
        if expiredTimerInfo.getExpiryTimeInMs() != due:
            return
        if over:
            self.known.clear()
            return
        yield _frame([self._end(key, "expired", turn, size, -1, parked, timerValues.getCurrentWatermarkInMs())])


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=t) for n, t in {"key": "object", "turn": "int64", "model": "object", "start": "int64", "size": "int64", "status": "object"}.items()})


def timed_dialogues(stream: DataFrame, late: str, patience_s: int, most_calls: int = 6, most_size: int = 1 << 20, memory_s: int = 86_400) -> DataFrame:
    """Turns that dialogues take, each with its start in the dialogue, and a row for each end.

    stream: (key string, turn long, model boolean, final boolean, size long, at timestamp). Rows without a key, turn or time can't be placed
    and are left out; a null flag is false, a null size 0. A turn below 0 is never taken.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    rows = stream.filter("key IS NOT NULL AND turn >= 0 AND at IS NOT NULL").withWatermark("at", late)
    rows = rows.select("key", "turn", flag("model"), flag("final"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("key").transformWithStateInPandas(Dialogue(patience_s * 1000, most_calls, most_size, memory_s * 1000), OUTPUT, "append", "eventTime")


class rocksdb:
    """Timers, map state and large joins need the RocksDB state store: set while a query is started, and put back.

    Rows of state aren't counted, as that reads each key before it is written, and a batch uploads its changes alone, not the whole store.
    """

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = {name: self.spark.conf.get(name, None) for name in STORE}
        for name, value in STORE.items():
            self.spark.conf.set(name, value)

    def __exit__(self, *_):
        for name, value in self.before.items():
            self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)
