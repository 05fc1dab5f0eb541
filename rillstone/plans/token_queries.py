"""Token arithmetic and sampling on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import distributions as D
from ..operators import sampling as S
from ..sources.tables import table

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("log_prob_at_label", f"WITH {E}, m AS (SELECT *, list_max(v) AS t FROM e) SELECT vec_id, round(v[label + 1] - t - ln(list_sum(list_transform(v, lambda x: exp(x - t)))), 5) AS log_prob, list_position(v, t) - 1 = label AS hit FROM m")
def log_prob(s, d):
    return vectors(s, d).select("vec_id", F.round(R.log_prob_at(F.col("v"), F.col("label")), 5).alias("log_prob"), R.is_argmax(F.col("v"), F.col("label")).alias("hit"))


@query("token_cross_entropy", f"WITH {E}, m AS (SELECT *, list_max(v) AS t FROM e), l AS (SELECT vec_id // 4 AS seq, -(v[label + 1] - t - ln(list_sum(list_transform(v, lambda x: exp(x - t))))) AS l, CASE WHEN list_position(v, t) - 1 = label THEN 1::DOUBLE ELSE 0 END AS a, vec_id % 3 <> 0 AS used FROM m) SELECT seq, round(coalesce(sum(l) FILTER (used), 0) / greatest(count(*) FILTER (used), 1), 5) AS loss, round(coalesce(sum(a) FILTER (used), 0) / greatest(count(*) FILTER (used), 1), 5) AS accuracy, CAST(count(*) FILTER (used) AS DOUBLE) AS n FROM l GROUP BY 1")
def cross_entropy(s, d):
    rows = vectors(s, d).select(F.expr("vec_id div 4").alias("seq"), F.struct("vec_id", "v", F.when(F.col("vec_id") % 3 != 0, F.col("label")).otherwise(-100).alias("y")).alias("x"))
    seq = rows.groupBy("seq").agg(F.array_sort(F.collect_list("x")).alias("s"))
    loss, acc, n = R.cross_entropy(F.col("s.v"), F.col("s.y"))
    return seq.select("seq", F.round(loss, 5).alias("loss"), F.round(acc, 5).alias("accuracy"), n.alias("n"))


@query("cumulative_lengths", "WITH q AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, [0::BIGINT] || list_transform(range(len(v)), lambda i: CAST(list_sum(v[1:i + 1]) AS BIGINT)) AS ends, list_max(v) AS longest FROM q")
def cumulative(s, d):
    q = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))).alias("s"))
    return q.select("l_orderkey", R.cumulative(F.col("s.q")).alias("ends"), F.array_max(F.col("s.q")).alias("longest"))


@query("inverse_permutation", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) - 1 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem) SELECT l_orderkey, list(CAST(i AS INTEGER) ORDER BY p) AS inverse FROM r GROUP BY 1")
def inverse(s, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey")
    r = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.row_number().over(w.orderBy("l_extendedprice", "l_partkey", "l_suppkey")) - 1).alias("p"))
    q = r.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p"))).alias("s"))
    return q.select("l_orderkey", R.inverse_permutation(F.col("s.p")).alias("inverse"))


@query("batch_reshape", "WITH q AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, list_transform(range(CAST(ceil(len(v) / 2.0) AS BIGINT)), lambda k: v[k * 2 + 1 : k * 2 + 2]) AS rows_ FROM q")
def reshape(s, d):
    q = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("v"))
    return q.select("l_orderkey", R.reshaped(F.col("v"), 2).alias("rows_"))


@query("kl_in_reward", "SELECT l_orderkey, round(sum(l_discount - 0.1::DOUBLE * (l_tax - l_discount)) , 6) AS reward, round(avg(l_tax - l_discount), 6) AS mean_kl FROM lineitem GROUP BY 1")
def kl_reward(s, d):
    from ..operators.advantages import reward_with_kl

    rows = reward_with_kl(table(s, d, "lineitem"), "l_discount", "l_tax", "l_discount", 0.1)
    return rows.groupBy("l_orderkey").agg(F.round(F.sum("token_reward"), 6).alias("reward"), F.round(F.avg("kl"), 6).alias("mean_kl"))


@query("token_covariance", "WITH m AS (SELECT avg(l_tax) AS ml, avg(l_discount) AS ma FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_tax - ml) * (l_discount - ma), 8) AS cov FROM lineitem, m")
def covariance(s, d):
    r = S.token_covariance(table(s, d, "lineitem"), "l_tax", "l_discount")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("cov", 8).alias("cov"))


@query("search_width", "WITH g AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2), h AS (SELECT user_id, -sum(p * ln(p)) AS h FROM g GROUP BY 1) SELECT user_id, round(h, 6) AS entropy, CAST(round_even(1 + least(greatest(h / ln(5), 0), 1) * 7, 0) AS INTEGER) AS width FROM h")
def width(s, d):
    c = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    h = c.groupBy("user_id").agg(D.entropy(F.array_sort(F.collect_list("n"))).alias("h"))
    return h.select("user_id", F.round("h", 6).alias("entropy"), D.width_for_entropy(F.col("h"), 5, 8).alias("width"))
