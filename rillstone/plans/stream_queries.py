"""Streaming operators on the driver's tables, replayed as file streams until all files are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from ..sources.tables import table
from ..streaming import dialogues as G
from ..streaming import metrics as M
from ..streaming import sinks as K
from ..streaming.joins import late_rewards

Q, SQL = {}, {}


def _checkpoint(s) -> str:
    return f"{scratch_dir(s)}/rillstone/stream-{uuid.uuid4().hex}"


def _stream(s, d, name):
    """The table as a stream of files: a folder of files, or the one file picked by its name."""
    schema, path = table(s, d, name).schema, s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return s.readStream.schema(schema).parquet(f"{d}/{name}.parquet")
    return s.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _events(s, d):
    return _stream(s, d, "events")


def running(s, d):
    out = _finished(s, M.running_metrics(_events(s, d), ["event_type"], "value"), "complete")
    return out.select("event_type", "n", F.round("mean", 5).alias("mean"), "least", "most")


def _finished(s, stream, mode):
    root = _checkpoint(s)
    return M.finished(stream, mode, root, f"{root}-result")


#: Event times have no zone: they are read, and shown again, as UTC, whatever the session's zone is.
AS_UTC = "CASE WHEN ts IS NOT NULL THEN timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))) END AS ts"


def _utc(column: str, pattern: str):
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz")), pattern)


def session_table(s, d):
    out = _finished(s, M.sessions(_events(s, d).selectExpr(AS_UTC, "user_id"), "ts", "6 hours", "user_id", "1 day"), "complete")
    return out.select("user_id", _utc("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


def hourly(s, d):
    out = _finished(s, M.windowed(_events(s, d).selectExpr(AS_UTC, "event_type", "value"), "ts", "1 day", "1 hour", ["event_type"], "value"), "complete")
    return out.select(_utc("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


#: Turns are dated from the table, replies of some a day late; the extra half second keeps whole seconds off the watermark.
DATED = "timestamp_seconds(1704067200 + conv_id * 60 + turn * 40 + (conv_id * 7 + turn * 11) % 5 * 15 + IF((conv_id + turn * 3) % 11 = 10, 86400, 0)) AS at"


def timed(s, d):
    rows = _stream(s, d, "conversations").selectExpr("CAST(conv_id AS STRING) AS key", "turn", "role = 'assistant' AS model", "char_length(text) % 7 = 0 AS final", "char_length(text) AS size", DATED)
    with G.rocksdb(s):
        out = _finished(s, G.timed_dialogues(rows, "90 seconds 500 milliseconds", 80, most_calls=3, most_size=2500), "append")
    return out.select(F.col("key").cast("long").alias("conv_id"), "turn", "start", "size", "status")


def _dated(column: str, name: str) -> str:
    return AS_UTC.replace("ts IS", f"{column} IS").replace("(ts AS", f"({column} AS").replace("AS ts", f"AS {name}")


def rewarded(s, d):
    rollouts = _stream(s, d, "orders").selectExpr("o_orderkey", _dated("o_orderdate", "at"))
    rewards = _stream(s, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_linenumber", "l_quantity AS reward", _dated("l_shipdate", "scored_at"))
    with G.rocksdb(s):
        out = _finished(s, late_rewards(rollouts, rewards, "o_orderkey", "at", "scored_at", "10 days 12 hours", "180 days"), "append")
    return out.select("o_orderkey", "l_linenumber", "reward", _utc("scored_at", "yyyy-MM-dd").alias("scored_on"))


def fanned(s, d):
    root = _checkpoint(s)
    K.fan_out(_events(s, d).select("event_type", "value"), {"table": K.folder(f"{root}-table"), "log": K.folder(f"{root}-log", "json")}, K.Ledger(s, f"{root}-ledger"), root).awaitTermination()
    read = s.read.schema("event_type string, value double")
    both = read.parquet(f"{root}-table/batch=*").withColumn("sink", F.lit("table")).unionByName(read.json(f"{root}-log/batch=*").withColumn("sink", F.lit("log")))
    marks = K.Ledger(s, f"{root}-ledger").entries().groupBy("sink").agg(F.sum("metrics.rows").alias("in_ledger"))
    sums = both.groupBy("sink", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.join(marks, "sink")


Q |= {"stream_running_metrics": running, "stream_sessions": session_table, "stream_windows": hourly, "stream_timed_dialogues": timed, "stream_late_rewards": rewarded, "stream_fan_out": fanned}
SQL |= {
    "stream_running_metrics": "SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, k",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_timed_dialogues": """
        WITH r AS (
            SELECT conv_id, turn, coalesce(role = 'assistant', false) AS model, coalesce(length(text) % 7 = 0, false) AS final, coalesce(length(text), 0) AS size,
                1704067200 + conv_id * 60 + turn * 40 + (conv_id * 7 + turn * 11) % 5 * 15 + CASE WHEN (conv_id + turn * 3) % 11 = 10 THEN 86400 ELSE 0 END AS dated
            FROM conversations WHERE conv_id IS NOT NULL AND turn >= 0
        ), m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY dated, size, model, final) = 1),
        p AS (
            SELECT *, row_number() OVER w - 1 AS k, dated > lag(dated) OVER w + 80 AS slow, coalesce(sum(CASE WHEN model THEN 1 ELSE 0 END) OVER b, 0) AS calls,
                coalesce(sum(size) OVER b, 0) AS start, coalesce(max(CASE WHEN model AND final THEN 1 ELSE 0 END) OVER b, 0) AS ended
            FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn), b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), g AS (SELECT *, max(CASE WHEN turn <> k OR slow OR ended = 1 OR calls >= 3 OR start >= 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS gone FROM p),
        e AS (
            SELECT conv_id, count(*) FILTER (gone = 0) AS turn, coalesce(sum(size) FILTER (gone = 0), 0) AS start, coalesce(sum(model::INT) FILTER (gone = 0), 0) AS calls,
                bool_or(gone = 0 AND model AND final) AS ended, coalesce(arg_max(dated, turn) FILTER (gone = 0), min(dated)) + 80 AS due FROM g GROUP BY conv_id
        ), s AS (
            SELECT e.*, CASE WHEN ended THEN 'end' WHEN calls >= 3 THEN 'calls' WHEN start >= 2500 THEN 'length'
                WHEN due < (SELECT max(dated) - 90.5 FROM r) OR (turn > 0 AND EXISTS (SELECT 1 FROM m WHERE m.conv_id = e.conv_id AND m.turn = e.turn AND m.dated > e.due)) THEN 'expired' END AS status FROM e
        )
        SELECT conv_id, turn, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size, NULL AS status FROM g WHERE gone = 0
        UNION ALL SELECT conv_id, turn, CAST(start AS BIGINT), CAST(0 AS BIGINT), status FROM s WHERE status IS NOT NULL""",
    "stream_late_rewards": """
        SELECT o_orderkey, l_linenumber, l_quantity AS reward, strftime(l_shipdate, '%Y-%m-%d') AS scored_on
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 180 DAY
        WHERE l_orderkey IS NOT NULL OR o_orderdate + INTERVAL 180 DAY < (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 252 HOUR)""",
    "stream_fan_out": "SELECT sink, event_type, count(*) AS n, round(sum(value), 4) AS total, (SELECT count(*) FROM events) AS in_ledger FROM events, (VALUES ('table'), ('log')) v(sink) GROUP BY 1, 2",
}
