"""Traversals and notation tokens on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lan_tokens as L
from ..functions import rollout_text as X
from ..operators import traversals as V
from ..sources.tables import table
from .corpus_queries import V as VISITS
from .corpus_queries import visits

Q, SQL = {}, {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


# trees: users; lines: days; a leaf's label is the length of its prefix modulo 3, less 1

NODES = f"WITH {VISITS}, n AS (SELECT user_id, prefix, depth, parent, min(day) AS ord FROM v GROUP BY ALL), a AS (SELECT n.user_id, n.prefix, unnest(range(1, n.depth + 1)) AS lv FROM n), p AS (SELECT a.user_id, a.prefix, list(m.ord ORDER BY a.lv) AS path FROM a JOIN n m ON m.user_id = a.user_id AND m.depth = a.lv AND (m.prefix = a.prefix OR starts_with(a.prefix, m.prefix || ' ')) GROUP BY 1, 2), t AS (SELECT n.user_id, n.depth, p.path, split_part(n.prefix, ' ', -1) AS move, CASE WHEN EXISTS (SELECT 1 FROM n c WHERE c.user_id = n.user_id AND c.parent = n.prefix AND c.depth = n.depth + 1) THEN '' ELSE ' <result>' || ['-1', '0', '+1'][length(n.prefix) % 3 + 1] || '</result>' END AS res FROM n JOIN p USING (user_id, prefix))"


def nodes(s, d):
    return V.nodes_of(visits(s, d), "user_id", "day").withColumn("label", F.length("prefix") % 3 - 1)


@query("traversal_depth_first", f"{NODES}, g AS (SELECT *, lag(depth) OVER (PARTITION BY user_id ORDER BY path) AS was, lead(depth) OVER (PARTITION BY user_id ORDER BY path) AS nxt FROM t) SELECT user_id, string_agg(CASE WHEN was IS NOT NULL AND depth = 1 THEN '<sep> ' ELSE '' END || '<down> ' || move || res || repeat(' <up>', CAST(depth + 1 - coalesce(nxt, 1) AS INTEGER)), ' ' ORDER BY path) AS text FROM g GROUP BY 1")
def depth_first(s, d):
    return V.traversal(nodes(s, d), "user_id", label="label", directions=True, separators=True)


@query("traversal_breadth_first", f"{NODES}, g AS (SELECT *, lag(depth) OVER (PARTITION BY user_id ORDER BY depth, path) AS was FROM t) SELECT user_id, string_agg(CASE WHEN was IS NULL OR was <> depth THEN '<level> ' ELSE '' END || move || res, ' ' ORDER BY depth, path) AS text FROM g GROUP BY 1")
def breadth_first(s, d):
    return V.traversal(nodes(s, d), "user_id", label="label", breadth=True, levels=True)


@query("traversal_by_subtree", f"{NODES}, g AS (SELECT *, lag(path[1]) OVER (PARTITION BY user_id ORDER BY path[1], depth, path) AS was FROM t) SELECT user_id, string_agg(CASE WHEN was <> path[1] THEN '<sep> ' ELSE '' END || move || ' [l' || depth || ']', ' ' ORDER BY path[1], depth, path) AS text FROM g GROUP BY 1")
def by_subtree(s, d):
    return V.traversal(nodes(s, d), "user_id", breadth=True, separators=True, layers=True)


@query("interleaved_replies", "WITH q AS (SELECT conv_id, list(role || turn ORDER BY turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, coalesce(array_to_string(list_transform(m[2:6], lambda x, i: CASE WHEN i % 2 = 1 THEN x || ' <call_env>' ELSE x END), ' '), '') AS text FROM q")
def replies(s, d):
    g = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", "turn").alias("m")))).alias("s"))
    return g.select("conv_id", V.interleaved(F.col("s.m")).alias("text"))


@query("notation_tokens", "WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'N' || chr(CAST(97 + l_partkey % 8 AS INTEGER)) || (l_suppkey % 8 + 1) || CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE '' END || chr(CAST(97 + l_suppkey % 8 AS INTEGER)) || (l_partkey % 8 + 1) || CASE WHEN l_partkey % 5 = 0 THEN '+' ELSE '' END AS m FROM lineitem) SELECT l_orderkey, string_agg(m, ' ' ORDER BY l_linenumber, m) AS back, CAST(sum(3 + CAST(l_partkey % 3 = 0 AS INTEGER) + CAST(l_partkey % 5 = 0 AS INTEGER)) + 2 AS BIGINT) AS n_ids FROM w GROUP BY 1")
def notation(s, d):
    letter = lambda c: F.char(97 + F.col(c) % 8)
    digit = lambda c: (F.col(c) % 8 + 1).cast("string")
    mark = lambda by, m: F.when(F.col("l_partkey") % by == 0, m).otherwise("")
    move = F.concat(F.lit("N"), letter("l_partkey"), digit("l_suppkey"), mark(3, "x"), letter("l_suppkey"), digit("l_partkey"), mark(5, "+"))
    g = table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", move.alias("m")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("s"))
    vocab = L.vocabulary()
    ids = L.ids_of(L.move_tokens(F.array_join("s.m", " ")), vocab)
    g = g.select("l_orderkey", ids.alias("ids"))
    return g.select("l_orderkey", L.text_of(F.col("ids"), vocab).alias("back"), F.size("ids").cast("long").alias("n_ids"))


@query("rate_schedules", "SELECT l_orderkey, l_linenumber, s AS step, round(CASE WHEN s < 10 THEN 0.1::DOUBLE + 0.9::DOUBLE * s / 10 ELSE greatest(0.1::DOUBLE, cos(pi() * (s - 10) / 190) * 0.45::DOUBLE + 0.55::DOUBLE) END, 6) AS cosine, round(CASE WHEN s < 10 THEN s / 10 WHEN s < 105 THEN 1::DOUBLE WHEN s < 200 THEN greatest(0::DOUBLE, 0.5::DOUBLE * (1 + cos(pi() * (s - 105) / 95))) * 0.9::DOUBLE + 0.1::DOUBLE ELSE 0.1::DOUBLE END, 6) AS stable FROM (SELECT l_orderkey, l_linenumber, l_partkey % 210 AS s FROM lineitem)")
def schedules(s, d):
    at = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 210).alias("step"))
    return at.withColumn("cosine", F.round(X.cosine_rate(F.col("step"), 10, 200, 0.1), 6)).withColumn("stable", F.round(X.stable_rate(F.col("step"), 10, 200, 0.1, stable=0.5), 6))


@query("response_cut", "WITH q AS (SELECT l_orderkey, list_filter(list(l_partkey % 5 ORDER BY l_linenumber, l_partkey), lambda x: x <> 1 AND x <> 0) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN list_position(ids, 2) > 0 THEN ids[1:list_position(ids, 2)] ELSE ids END AS ids FROM q")
def response(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return g.select("l_orderkey", X.response_ids(F.transform("s.l_partkey", lambda x: x % 5), 2, 1).alias("ids"))
