"""Lookups, ordered picks and stage reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..operators import prep as P
from ..sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


def orders(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")


@query("last_by_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def last(s, d):
    return L.last_by_key(orders(s, d).select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("lookup_with_default", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey")
def lookup(s, d):
    n = orders(s, d).filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return L.lookup(table(s, d, "customer").select("c_custkey"), n, ["c_custkey"], {"n_orders": 0})


@query("skipped_rows", "SELECT count(*) AS skipped FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skipped(s, d):
    return L.matched_and_skipped(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", "quality"), ["doc_id"])[1]


@query("committed_gap", "SELECT o_orderkey, o_custkey, o_totalprice, best, o_totalprice - best AS gap FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O') LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey)")
def gap(s, d):
    o = orders(s, d)
    return L.committed_gap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")


@query("majority_truth", "WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, arg_max(o_orderpriority, n * 100000000 - f) AS t FROM v GROUP BY 1) SELECT o_orderkey, t AS o_orderstatus, o_orderstatus AS original_o_orderstatus FROM orders JOIN m USING (o_custkey)")
def truth(s, d):
    return L.replaced_truth(orders(s, d), ["o_custkey"], "o_orderpriority", "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus", "original_o_orderstatus")


@query("block_first_k", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem) WHERE p <= 2")
def firsts(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    return L.block_first(t, "l_orderkey", "at", 2).drop("at")


@query("argmax_tie_break", "SELECT p_brand, arg_max(p_partkey, p_size::BIGINT * 100000000 + p_partkey) AS p_partkey, max(p_size) AS p_size FROM part GROUP BY 1")
def argbest(s, d):
    return L.argbest(table(s, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_size", "p_partkey")


@query("worst_to_best", "SELECT s_nationkey, string_agg(s_name, ' <sep> ' ORDER BY s_acctbal, s_name) AS s_name FROM supplier GROUP BY 1")
def ordered(s, d):
    return L.worst_to_best(table(s, d, "supplier"), "s_nationkey", "s_acctbal", "s_name")


@query("top_by_max_severity", "SELECT * FROM (SELECT event_type, user_id, max(value) AS value, row_number() OVER (PARTITION BY event_type ORDER BY max(value) DESC, user_id) AS place FROM events GROUP BY 1, 2) WHERE place <= 5")
def severity(s, d):
    return L.top_by_max(table(s, d, "events"), "event_type", "user_id", "value", 5)


@query("stage_summary", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'X') AS n_X, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS mean_O, round(avg(o_totalprice) FILTER (o_orderstatus = 'X'), 4) AS mean_X FROM orders GROUP BY 1")
def summary(s, d):
    r = L.stage_summary(orders(s, d), "o_orderpriority", "o_orderstatus", ["F", "O", "X"], "o_totalprice")
    return r.select(*[F.round(c, 4).alias(c) if c.startswith("mean") else F.col(c) for c in r.columns])


@query("bracket_fractions", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS fraction FROM orders GROUP BY 1, 2")
def brackets(s, d):
    return L.bracket_fractions(orders(s, d), ["o_orderpriority"], "o_orderstatus").withColumn("fraction", F.round("fraction", 6))


@query("fit_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75, round(avg(value), 5) AS mean FROM events GROUP BY 1")
def quantiles(s, d):
    r = L.fit_quantiles(table(s, d, "events"), "event_type", "value")
    return r.select("event_type", *[F.round(c, 5).alias(c) for c in r.columns[1:]])


@query("greedy_bins", "WITH RECURSIVE t AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem), r AS (SELECT l_orderkey, k, q AS used, 0 AS bin FROM t WHERE k = 1 UNION ALL SELECT t.l_orderkey, t.k, CASE WHEN r.used + t.q > 60 THEN t.q ELSE r.used + t.q END, r.bin + CASE WHEN r.used + t.q > 60 THEN 1 ELSE 0 END FROM r JOIN t ON t.l_orderkey = r.l_orderkey AND t.k = r.k + 1) SELECT l_orderkey, list(CAST(bin AS INTEGER) ORDER BY k) AS bins FROM r GROUP BY 1")
def greedy(s, d):
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))).alias("s"))
    return t.select("l_orderkey", L.greedy_bins(F.col("s.q"), 60).alias("bins"))


@query("outcome_distribution", "SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal > 300 THEN 1::DOUBLE ELSE 0 END), 6) AS win, round(avg(CASE WHEN abs(c_acctbal) <= 300 THEN 1::DOUBLE ELSE 0 END), 6) AS draw, round(avg(CASE WHEN c_acctbal < -300 THEN 1::DOUBLE ELSE 0 END), 6) AS loss FROM customer GROUP BY 1")
def outcomes(s, d):
    r = L.outcome_distribution(table(s, d, "customer"), "c_mktsegment", "c_acctbal")
    return r.select("c_mktsegment", *[F.round(c, 6).alias(c) for c in ("win", "draw", "loss")])


@query("throughput", "SELECT CAST(sum(n_chars) AS BIGINT) AS tokens, round(sum(n_chars) / (count(*) * 0.5::DOUBLE * 8), 5) AS tokens_per_device_second, round(count(*) * 0.5::DOUBLE * 1000 / sum(n_chars), 6) AS ms_per_token FROM documents")
def speed(s, d):
    r = L.throughput(table(s, d, "documents").withColumn("t", F.lit(0.5)), "n_chars", "t", 8)
    return r.select("tokens", F.round("tokens_per_device_second", 5).alias("tokens_per_device_second"), F.round("ms_per_token", 6).alias("ms_per_token"))


@query("shard_wraparound", "WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k FROM orders), n AS (SELECT o_orderpriority, least(count(*), 10) AS n FROM r GROUP BY 1), g AS (SELECT o_orderpriority, n, CAST(x AS INTEGER) AS slot FROM n, range(25) t(x)) SELECT o_orderpriority, slot, o_orderkey FROM g JOIN r USING (o_orderpriority) WHERE r.k = slot % n")
def wrap(s, d):
    # only the first 10 rows of a shard are read; the limit by shard is applied before the shuffle
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1
    r = orders(s, d).select("o_orderpriority", "o_orderkey", k.alias("k")).filter("k < 10")
    return L.shard_local_windows(r, "o_orderpriority", "k", 10, 25).select("o_orderpriority", "slot", "o_orderkey")


@query("content_first_rows", "WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS content_hash FROM c WHERE t = '' OR doc_id = (SELECT min(b.doc_id) FROM c b WHERE b.t = c.t)")
def content(s, d):
    return P.first_per_hash(table(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "content_hash")


@query("identifier_extraction", "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, md5(url) AS path_hash, CASE WHEN url LIKE '%?%' THEN split_part(url, '?', 2) ELSE url END AS tail FROM pages WHERE regexp_matches(url, '[0-9]')")
def identifiers(s, d):
    t = table(s, d, "pages").filter(F.col("url").rlike("[0-9]"))
    tail = F.when(F.col("url").contains("?"), F.get(F.split("url", r"\?"), F.lit(1))).otherwise(F.col("url"))
    return t.select("page_id", F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")).alias("host"), F.md5("url").alias("path_hash"), tail.alias("tail"))


@query("metric_long_form", "SELECT event_type, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'mean', round(avg(value), 6) FROM events GROUP BY 1")
def long_form(s, d):
    w = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return w.unpivot("event_type", ["n", "mean"], "metric", "value")
