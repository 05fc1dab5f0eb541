"""Batch shapes, sampling, budgets and rows of search trees on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import growth as W
from ..operators import prep as P
from ..sources.tables import table
from .corpus_queries import O, orders

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def numbered(s, d):
    return B.numbered(orders(s, d), ["o_orderkey"])


@query("batch_concat", f"WITH {O}, n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, \"row\" FROM o UNION ALL SELECT o_orderkey, \"row\" + n FROM o, n")
def concat(s, d):
    o = numbered(s, d)
    return B.rows_concat([o, o]).select("o_orderkey", "row")


@query("batch_pad_last", f"WITH {O}, n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, \"row\" FROM o UNION ALL SELECT o_orderkey, n + k FROM o, n, range(5) r(k) WHERE \"row\" = n - 1")
def pad_last(s, d):
    o = numbered(s, d)
    return B.pad_with_row(o, o.count(), 5, last=True).select("o_orderkey", "row")


@query("mini_batches", f"WITH {O}, e AS (SELECT o_orderkey, CAST(epoch AS INT) AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || \"row\")) - 1 AS k FROM o, range(2) r(epoch)) SELECT o_orderkey, epoch, CAST(k // 5 AS INT) AS mini_batch, CAST(k % 5 AS INT) AS place FROM e")
def minis(s, d):
    o = numbered(s, d)
    return B.mini_batches(o, o.count(), 5, 2, 7).select("o_orderkey", "epoch", "mini_batch", "place")


@query("batch_pick", f"WITH {O}, p AS (SELECT unnest([5, 3, 3, 0, 99]) AS r, generate_subscripts([5, 3, 3, 0, 99], 1) - 1 AS k) SELECT o_orderkey, k AS \"row\" FROM p JOIN o ON o.\"row\" = r")
def picked(s, d):
    return B.pick(numbered(s, d), [5, 3, 3, 0, 99]).select("o_orderkey", "row")


@query("batch_mask", f"WITH {O} SELECT o_orderkey, row_number() OVER (ORDER BY \"row\") - 1 AS \"row\" FROM o WHERE \"row\" < 50 AND \"row\" % 3 = 0")
def masked(s, d):
    return B.item(numbered(s, d), [k % 3 == 0 for k in range(50)], 0).select("o_orderkey", "row")


@query("batch_reorder", f"WITH {O}, n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, n - 1 - \"row\" AS \"row\" FROM o, n")
def reorder(s, d):
    o = numbered(s, d)
    n = o.count()
    return B.reordered(o, o.select((n - 1 - F.col("row")).alias("place"), "row")).select("o_orderkey", "row")


@query("batch_pop", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def popped(s, d):
    taken, left = B.pop(numbered(s, d), ["o_totalprice"])
    taken = B.renamed(taken, ["o_totalprice"], ["price"])
    return B.project(left.join(taken, "row"), ["o_orderkey", "price"])


@query("train_loader", f"WITH {O}, b AS (SELECT o_orderkey, \"row\" // 32 AS batch, count(*) OVER (PARTITION BY \"row\" // 32) AS n FROM o) SELECT o_orderkey, batch FROM b WHERE n = 32")
def train(s, d):
    return B.loader(numbered(s, d), 32, True).select("o_orderkey", "batch")


@query("seeded_order", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) - 1 AS place FROM orders")
def seeded(s, d):
    return B.sampler(table(s, d, "orders").select("o_orderkey"), "o_orderkey", True, 3)


@query("sample_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('1:' || o_orderkey), o_orderkey LIMIT 100")
def sample(s, d):
    return B.sample_n(orders(s, d), "o_orderkey", 100, 1)


U = "CAST('0x' || substr(md5({k}), 1, 12) AS BIGINT)"


@query("resample_weighted", f"WITH w AS (SELECT o_orderkey, CAST(greatest(round(greatest(power(abs(o_totalprice / 1000), 2) + 1e-8::DOUBLE, 1e-8::DOUBLE) * 100), 1) AS BIGINT) AS w FROM orders), c AS (SELECT *, sum(w) OVER (ORDER BY o_orderkey) - w AS low, sum(w) OVER () AS whole FROM w), t AS (SELECT max(whole) AS whole FROM c), d AS (SELECT range AS draw, CAST(floor({U.format(k=chr(39) + '1:' + chr(39) + ' || range')} / 281474976710656.0::DOUBLE * whole::DOUBLE) AS BIGINT) AS pt FROM range(2000), t) SELECT draw, o_orderkey FROM d JOIN c ON pt >= low AND pt < low + w")
def resample(s, d):
    weight = B.resample_weights(F.col("o_totalprice") / 1000)
    return B.drawn(orders(s, d), "o_orderkey", weight, 2000, 1, 100.0).select("draw", "o_orderkey")


@query("resample_extremes", "WITH x AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT DISTINCT l_quantity, CASE WHEN l_quantity IN (lo, hi) THEN 1.00000001::DOUBLE ELSE 1e-8::DOUBLE END AS max_min, CASE WHEN l_quantity = hi THEN 0.40000001::DOUBLE ELSE 0.10000001::DOUBLE END AS max_random FROM lineitem, x")
def extremes(s, d):
    t = table(s, d, "lineitem")
    ends = t.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    rows = t.select("l_quantity").distinct().crossJoin(F.broadcast(ends))  # one row
    weight = lambda m: B.resample_weights(F.col("l_quantity"), m, extremes=(F.col("lo"), F.col("hi")))
    return rows.select("l_quantity", weight("max_min").alias("max_min"), weight("max_random").alias("max_random"))


@query("gumbel_policy", f"WITH u AS (SELECT p_brand, p_partkey, p_size, ({U.format(k=chr(39) + '1:' + chr(39) + ' || p_brand || ' + chr(39) + ':' + chr(39) + ' || p_partkey')} + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM part), g AS (SELECT *, p_size / 5.0::DOUBLE - ln(-ln(u)) AS g FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY g DESC, p_partkey) AS draw FROM g) SELECT p_brand, p_partkey, p_size, draw FROM r WHERE draw <= 3")
def gumbel(s, d):
    from ..operators.sampling import gumbel_sample

    return gumbel_sample(table(s, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", "p_size", 3, 5.0, 1)


@query("rank_spread", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS most, min(l_extendedprice) AS least, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1")
def spread(s, d):
    r = B.spread(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", F.round("mean", 4).alias("mean"), "most", "least", F.round("std", 4).alias("std"))


@query("rows_to_lists", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS o_orderkey, list(o_orderstatus ORDER BY o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def lists(s, d):
    return B.as_lists(table(s, d, "orders").withColumn("k", F.col("o_orderkey")), ["o_custkey"], "k", ["o_orderkey", "o_orderstatus"])


@query("token_budget", "WITH n AS (SELECT n_nationkey, n_nationkey * 10 + 100 AS tokens, row_number() OVER (ORDER BY n_nationkey DESC) AS back FROM nation) SELECT n_nationkey, CAST(tokens AS BIGINT) AS tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY n_nationkey) AS s FROM n WHERE back > 3) WHERE s <= 2000")
def token_budget(s, d):
    shards = table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 10 + 100).cast("long").alias("tokens"))
    return B.within_budget(shards, "n_nationkey", "tokens", 2000, 3)


@query("useful_prompts", "WITH g AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'R' THEN 1::DOUBLE ELSE 0 END) AS m FROM lineitem GROUP BY 1) SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM g WHERE m > 0 AND m < 0.75)")
def useful(s, d):
    from ..operators.evaluation import group_filter

    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").cast("double").alias("hit"))
    good = group_filter(rows, "o_orderkey", "hit", 0.75).filter("verdict = 'useful'")
    return B.useful_rows(table(s, d, "orders").select("o_orderkey"), good, "o_orderkey", 1)


@query("reliable_rows", "SELECT p_partkey FROM part WHERE p_size <= 100 AND p_partkey >= 50 AND p_retailprice - 905 >= 0")
def reliable(s, d):
    t = table(s, d, "part").withColumn("margin", F.col("p_retailprice") - 905)
    return t.filter(P.reliable("p_size", "p_partkey", "margin")).select("p_partkey")


@query("complete_rows", "SELECT doc_id FROM (SELECT doc_id, nullif(lang, 'de') AS a, nullif(source, 's0') AS b FROM documents) WHERE a IS NOT NULL AND b IS NOT NULL")
def complete(s, d):
    t = table(s, d, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("de")).alias("a"), F.nullif(F.col("source"), F.lit("s0")).alias("b"))
    return P.complete_rows(t, ["a", "b"]).select("doc_id")


@query("test_sources", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')")
def of_sources(s, d):
    return P.of_sources(table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).select("o_orderkey")


@query("header_ids", """WITH h AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '[Event "x"] [Site "https://games.example/' || substr(md5(o_orderkey::VARCHAR), 1, 10) || '"]' WHEN 1 THEN '[Link "http://games.example/' || substr(md5(o_orderkey::VARCHAR), 1, 8) || '/white"]' ELSE '[Site "?"]' END AS t FROM orders) SELECT o_orderkey, coalesce(nullif(regexp_extract(t, '\\[Site\\s+"https?://[^/"]+/([A-Za-z0-9]{8})', 1), ''), nullif(regexp_extract(t, '\\[Link\\s+"https?://[^/"]+/([A-Za-z0-9]{8})', 1), '')) AS id FROM h""")
def headers(s, d):
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('[Event "x"] [Site "https://games.example/'), F.substring(h, 1, 10), F.lit('"]'))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('[Link "http://games.example/'), F.substring(h, 1, 8), F.lit('/white"]'))).otherwise('[Site "?"]')
    return table(s, d, "orders").select("o_orderkey", P.header_id(text).alias("id"))


# trees


@query("leaf_labels", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN (CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_partkey % 2 END) END AS w, CAST(CASE WHEN p_size % 7 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 0 WHEN p_partkey % 2 = 1 THEN 1 ELSE -1 END WHEN p_size % 5 = 0 THEN CASE WHEN p_partkey % 3 > 0 THEN 1 ELSE -1 END WHEN p_retailprice - 1300 > 300 THEN 1 WHEN p_retailprice - 1300 < -300 THEN -1 ELSE 0 END AS INT) AS label FROM part")
def labels(s, d):
    winner = F.when((F.col("p_size") % 7 == 0) & (F.col("p_size") % 2 != 0), F.col("p_partkey") % 2)
    mate = F.when(F.col("p_size") % 5 == 0, F.col("p_partkey") % 3)
    label = W.leaf_label(F.col("p_size") % 7 == 0, winner == 1, mate, F.col("p_retailprice") - 1300)
    return table(s, d, "part").select("p_partkey", winner.alias("w"), label.alias("label"))


@query("scores_from_side", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE -p_retailprice END AS value FROM part")
def sides(s, d):
    t = table(s, d, "part").withColumn("white", F.col("p_size") % 2 == 0)
    return W.forced_values(t, "p_brand", "p_partkey", "white", "p_retailprice").select("p_partkey", "value")


@query("ordered_moves", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def ordered(s, d):
    return W.ordered_by_score(table(s, d, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "place")


@query("generator_slots", "WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS candidate_no, o_orderkey AS candidate FROM orders), x AS (SELECT o_custkey, candidate_no, candidate, l AS line FROM r, range(2) t(l)), n AS (SELECT *, row_number() OVER (ORDER BY o_custkey, candidate_no, line) - 1 AS slot FROM x) SELECT slot, o_custkey, CAST(candidate_no AS INT) AS candidate_no, candidate, CAST(line AS INT) AS line FROM n UNION ALL SELECT (SELECT count(*) FROM n) + k, NULL, NULL, NULL, NULL FROM range(16) p(k) WHERE k < (16 - (SELECT count(*) FROM n) % 16) % 16")
def generator_slots(s, d):
    lists = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("c")).withColumn("n", F.lit(2))
    return W.slots(lists, "o_custkey", "c", "n").select("slot", "o_custkey", "candidate_no", "candidate", "line")


@query("missing_scores", "SELECT DISTINCT o_custkey, 'no scores' AS error FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing(s, d):
    scores = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return W.engine_failures(table(s, d, "orders"), scores, "o_custkey")
