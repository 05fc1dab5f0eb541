"""Text and notation helpers, and round trips through files, on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import distributions as D
from ..functions import rollout_text as Y
from ..functions import text as X
from ..operators import advantages as A
from ..operators import lookups as L
from ..operators import prep as P
from ..operators import rewards as W
from ..operators import states as S
from ..sources import files
from ..sources.scratch import scratch_dir
from ..sources.tables import table
from .evaluation_queries import PAIRS, pairs

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# outputs: a part's name in the markup of traces

TRACE = "concat(CASE WHEN p_size % 3 = 0 THEN '<T> ' ELSE 'x ' END, p_name, ' <sep> ', p_brand, ' <call_env> ', p_type, CASE WHEN p_size % 2 = 0 THEN ' </T> ' ELSE ' ' END, CAST(p_partkey AS VARCHAR(9)))"


def parts(s, d, *more):
    return table(s, d, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_retailprice", F.expr(TRACE).alias("t"), *more)


@query("reasoning_parts", f"WITH p AS (SELECT p_partkey, {TRACE} AS t FROM part) SELECT p_partkey, CASE WHEN contains(t, '</T>') THEN split_part(t, '</T>', 1) WHEN contains(t, '<T>') THEN substr(t, strpos(t, '<T>') + 3) ELSE '' END AS reasoning, CASE WHEN contains(t, '</T>') THEN trim(split_part(t, '</T>', 2)) END AS answer, len(string_split(t, '</T>')) = 2 AS formatted FROM p")
def reasoning(s, d):
    t = F.col("t")
    return parts(s, d).select("p_partkey", X.reasoning(t).alias("reasoning"), X.answer_part(t).alias("answer"), X.well_formed(t).alias("formatted"))


@query("trace_lines", f"WITH p AS (SELECT p_partkey, {TRACE} AS t FROM part), r AS (SELECT p_partkey, CASE WHEN contains(t, '</T>') THEN split_part(t, '</T>', 1) WHEN contains(t, '<T>') THEN substr(t, strpos(t, '<T>') + 3) ELSE '' END AS t FROM p) SELECT p_partkey, list_filter(list_transform(string_split(t, '<sep>'), lambda x: list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda w: w NOT IN ('<T>', '</T>', '<sep>', '<call_env>', ''))), lambda y: len(y) > 0) AS lines FROM r")
def lines(s, d):
    return parts(s, d).select("p_partkey", X.lines_of(F.col("t")).alias("lines"))


@query("without_replies", f"WITH p AS (SELECT p_partkey, {TRACE} AS t FROM part) SELECT p_partkey, trim(regexp_replace(t, '\\s*<call_env>\\s+\\S+', '', 'g')) AS t FROM p")
def stripped(s, d):
    return parts(s, d).select("p_partkey", X.strip_env_pairs(F.col("t")).alias("t"))


ANSWERED = "concat('so <answer> ', p_name, ' </answer> then <answer>', p_brand, CASE WHEN p_size % 2 = 0 THEN '</answer>' ELSE '' END, ' 1,', p_partkey, '. #### ', CASE WHEN p_size % 3 = 0 THEN '1,234' ELSE CAST(p_size AS VARCHAR(9)) END)"


@query("tagged_answers", f"WITH p AS (SELECT p_partkey, p_size, p_name, p_brand, {ANSWERED} AS t FROM part) SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS answer, CASE WHEN p_size % 3 = 0 THEN '1234' ELSE p_size::VARCHAR END AS strict, CASE WHEN p_size % 3 = 0 THEN '1234' ELSE p_size::VARCHAR END AS flexible FROM p")
def tagged(s, d):
    t = F.expr(ANSWERED)
    return table(s, d, "part").select("p_partkey", X.last_answer(t).alias("answer"), X.strict_number(t).alias("strict"), X.flexible_number(t).alias("flexible"))


@query("answer_rewards", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1::DOUBLE ELSE 0.1::DOUBLE END AS em, CASE WHEN p_size % 3 = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS number FROM part")
def rewards(s, d):
    t = F.concat(F.lit("<answer>The "), F.col("p_name"), F.lit("!</answer> #### "), F.col("p_partkey").cast("string"))
    gold = F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("zzz"))
    number = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey")).otherwise(-1).cast("string")
    return table(s, d, "part").select("p_partkey", W.exact_answer(t, gold, 1.0, 0.1).alias("em"), W.number_answer(t, number).alias("number"))


@query("score_labels", "WITH c AS (SELECT s_suppkey, round(s_acctbal / 10) AS cp FROM supplier), l AS (SELECT *, CASE WHEN abs(cp) > 300 THEN '3' WHEN abs(cp) > 150 THEN '2' WHEN abs(cp) > 75 THEN '1' WHEN abs(cp) > 25 THEN '0.5' ELSE '0' END AS l FROM c) SELECT s_suppkey, CASE WHEN l = '0' THEN '0' WHEN cp > 0 THEN '+' || l ELSE '-' || l END AS label FROM l")
def score_labels(s, d):
    return table(s, d, "supplier").select("s_suppkey", X.cp_label(F.round(F.col("s_acctbal") / 10)).alias("label"))


@query("position_keys", "SELECT s_suppkey, s_name || ' w' AS key, CAST(s_nationkey AS INT) AS size FROM supplier")
def positions(s, d):
    fen = F.concat(F.col("s_name"), F.lit(" w KQkq - 0 1"))
    tag = F.concat(F.lit("run_"), F.col("s_nationkey").cast("string"), F.lit("m"))
    return table(s, d, "supplier").select("s_suppkey", X.position_key(fen).alias("key"), X.model_size_millions(tag).alias("size"))


@query("listed_values", "SELECT o_custkey % 50 AS k, [o_orderstatus, o_orderpriority[1:1]] AS json, [o_orderstatus, 'x'] AS plain FROM orders")
def listed(s, d):
    json = F.concat(F.lit("['"), F.col("o_orderstatus"), F.lit("', '"), F.substring("o_orderpriority", 1, 1), F.lit("']"))
    plain = F.concat(F.col("o_orderstatus"), F.lit(", x"))
    return table(s, d, "orders").select((F.col("o_custkey") % 50).alias("k"), X.decode_list(json).alias("json"), X.decode_list(plain).alias("plain"))


@query("overlong_penalties", "SELECT doc_id, round(least(-(n_chars - 3000) / 1000::DOUBLE * 0.5, 0), 6) AS penalty FROM documents")
def overlong(s, d):
    return table(s, d, "documents").select("doc_id", F.round(W.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5), 6).alias("penalty"))


SEQ = "q AS (SELECT l_orderkey, list((l_suppkey % 3 > 0)::INT ORDER BY l_linenumber, l_partkey, l_suppkey) AS m, list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey) AS v, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1)"


def sequences(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount"))).alias("s"))
    return g.select("l_orderkey", F.transform("s", lambda x: (x["l_suppkey"] % 3 > 0).cast("int")).alias("m"), F.col("s.l_discount").alias("v"), F.transform("s", lambda x: x["l_partkey"] % 7).alias("ids"))


@query("masked_means", f"WITH {SEQ} SELECT l_orderkey, round(list_sum(list_transform(v, lambda x, i: x * m[i])) / (list_sum(m) + 1e-8::DOUBLE), 6) AS mean, round(list_sum(list_transform(v, lambda x, i: x * m[i])), 6) AS total FROM q")
def masked(s, d):
    return sequences(s, d).select("l_orderkey", F.round(R.masked_mean(F.col("v"), F.col("m")), 6).alias("mean"), F.round(R.masked_sum(F.col("v"), F.col("m")), 6).alias("total"))


@query("last_token_rewards", f"WITH {SEQ}, l AS (SELECT *, list_max(list_transform(m, lambda x, i: CASE WHEN x = 1 THEN i ELSE 0 END)) AS last FROM q) SELECT l_orderkey, list_transform(m, lambda x, i: CASE WHEN i = last THEN 2.5::DOUBLE ELSE 0::DOUBLE END) AS token_rewards FROM l")
def placed(s, d):
    return W.place_on_last_token(sequences(s, d).withColumn("score", F.lit(2.5)), "score", "m").select("l_orderkey", "token_rewards")


@query("response_lengths", f"WITH {SEQ} SELECT l_orderkey, list_sum(m) AS total, list_sum(m[1:2]) AS prompt, list_sum(m) - list_sum(m[1:2]) AS response FROM q")
def lengths(s, d):
    q = sequences(s, d)
    head = F.slice("m", F.lit(1), F.lit(2))
    tail = F.slice("m", F.lit(3), F.size("m"))
    prompt, response = L.response_lengths(tail, head)
    return q.select("l_orderkey", (prompt + response).cast("long").alias("total"), prompt.cast("long").alias("prompt"), response.cast("long").alias("response"))


@query("state_fits", f"WITH {PAIRS} SELECT user_id, round(regr_slope(ln(q), ln(p)), 4) AS slope, count(*) AS n FROM j WHERE p > 1e-12 AND q > 1e-12 GROUP BY 1 HAVING count(*) > 2 AND var_pop(ln(p)) > 1e-6")
def state_fits(s, d):
    r = S.log_ratio_fit(pairs(s, d), ["user_id"])
    spread = pairs(s, d).filter("p > 1e-12 and q > 1e-12").groupBy("user_id").agg(F.var_pop(F.ln("p")).alias("spread")).filter("spread > 1e-6")
    return r.join(spread, "user_id", "left_semi").filter("n > 2").select("user_id", F.round("slope", 4).alias("slope"), "n")


@query("centred_logs", "SELECT vec_id, list_transform(e, lambda x: round(ln(greatest(abs(x), 1e-12::DOUBLE)) - list_avg(list_transform(e, lambda y: ln(greatest(abs(y), 1e-12::DOUBLE)))), 4)) AS c, round(ln(least(greatest(abs(e[1]), 1e-6), 1 - 1e-6) / (1 - least(greatest(abs(e[1]), 1e-6), 1 - 1e-6))), 4) AS logit FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def centred(s, d):
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(s, d, "embeddings").select("vec_id", e.alias("e"))
    return rows.select("vec_id", F.transform(D.centred_log(F.col("e")), lambda x: D.rounded(x, 4)).alias("c"), D.rounded(D.logit(F.get("e", F.lit(0))), 4).alias("logit"))


@query("estimator_by_name", "WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 701 AS r, avg(l_extendedprice / 701) OVER w AS m, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN n = 1 THEN r ELSE (r - m) * n / (n - 1)::DOUBLE END, 6) AS advantage FROM g")
def by_name(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 701).alias("r"))
    return A.ESTIMATORS["rloo"](rows, "l_orderkey", "r").select("l_orderkey", "l_linenumber", "l_partkey", F.round("advantage", 6).alias("advantage"))


@query("first_of_columns", "SELECT o_orderkey, o_orderstatus AS x FROM orders")
def first_of(s, d):
    t = table(s, d, "orders")
    return t.select("o_orderkey", P.first_existing(t, "ctx", "o_orderstatus").alias("x"))


@query("zipped_lists", f"WITH {SEQ} SELECT l_orderkey, list_transform(m, lambda x, i: x * 10 + ids[i]) AS z FROM q")
def zipped(s, d):
    z = L.zipped("m", "ids")
    return sequences(s, d).select("l_orderkey", F.transform(z, lambda x: x["m"] * 10 + x["ids"]).alias("z"))


@query("vocabulary_unions", f"WITH {SEQ}, u AS (SELECT l_orderkey, ids || list_transform(ids, lambda x: x * 2) AS l FROM q) SELECT l_orderkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS vocabulary FROM u")
def unions(s, d):
    return sequences(s, d).select("l_orderkey", L.ordered_union(F.col("ids"), F.transform("ids", lambda x: x * 2)).alias("vocabulary"))


@query("shown_ids", f"WITH {SEQ} SELECT l_orderkey, array_to_string(list_transform(ids, lambda i: CASE WHEN i < 5 THEN ['a', 'b', 'c', 'd', 'e'][i + 1] ELSE '?' END), '') AS t FROM q")
def shown(s, d):
    return sequences(s, d).select("l_orderkey", Y.shown(F.col("ids"), {w: k for k, w in enumerate("abcde")}).alias("t"))


# round trips through files


def _path(s, name):
    return f"{scratch_dir(s)}/rillstone/{name}-{uuid.uuid4().hex}"


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
KIND = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("parquet_round_trip", ORDERS)
def parquet(s, d):
    path = _path(s, "trip")
    files.write_parquet(_orders(s, d), f"{path}/part=1/deep", 500)
    return files.parquet_tree(s, path)


@query("csv_round_trip", ORDERS)
def csv(s, d):
    path = _path(s, "trip")
    files.write_csv(_orders(s, d), path, ["o_orderkey", "o_custkey", "missing", "o_orderstatus", "o_totalprice"])
    return files.csv_table(s, path, KIND)


@query("json_round_trip", ORDERS)
def json_lines(s, d):
    path = _path(s, "trip")
    files.write_json_steps(_orders(s, d), path, "o_orderstatus")
    return files.json_lines(s, path, KIND)


@query("sharded_json_round_trip", ORDERS)
def sharded(s, d):
    path = _path(s, "trip")
    files.write_sharded_json(_orders(s, d), path, 300)
    return files.json_lines(s, path, KIND)


@query("metric_log", "SELECT o_orderstatus, 'n' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'top', max(o_totalprice) FROM orders GROUP BY 1")
def metric_log(s, d):
    path = _path(s, "trip")
    wide = _orders(s, d).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    files.log_metrics(wide, path, ["o_orderstatus"])
    return s.read.parquet(path)


@query("split_games", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def games(s, d):
    game = F.concat(F.lit('[Event "'), F.col("o_orderkey").cast("string"), F.lit('"]\n\n1. e4 *\n'))
    blobs = table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(game), "\n").alias("t"))
    return blobs.select("o_custkey", F.size(files.split_games(F.col("t"))).cast("long").alias("n"))
