"""Rollout rows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas
from ..functions import math_answers as A
from ..operators import rollouts as R
from ..operators import walks as W
from ..sources.tables import spread, table

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


SEQ = "q AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS sups FROM lineitem GROUP BY 1)"


def sequences(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("s"))
    return g.select("l_orderkey", F.col("s.l_partkey").alias("ids"), F.col("s.l_suppkey").alias("sups"))


@query("prompt_length_filter", f"WITH {SEQ} SELECT l_orderkey, ids FROM q WHERE len(ids) <= 3")
def short(s, d):
    return R.short_prompts(sequences(s, d), "ids", 3).select("l_orderkey", "ids")


@query("collate_padded", f"WITH {SEQ}, b AS (SELECT *, l_orderkey // 8 AS batch, max(len(ids)) OVER (PARTITION BY l_orderkey // 8) AS n FROM q) SELECT l_orderkey, batch, list_resize(ids, n, 0::BIGINT) AS ids, list_resize(sups, n, -100::BIGINT) AS sups, list_transform(range(n), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS attention_mask FROM b")
def collate(s, d):
    return R.collated(sequences(s, d).withColumn("batch", F.expr("l_orderkey div 8")), "batch", "ids", "sups").select("l_orderkey", "batch", "ids", "sups", "attention_mask")


@query("accuracy_by_depth", f"WITH {SEQ}, x AS (SELECT unnest(range(len(sups))) AS depth, ids, sups FROM q) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n, round(avg(CASE WHEN ids[depth + 1] % 5 = sups[depth + 1] % 5 THEN 1::DOUBLE ELSE 0 END), 6) AS accuracy FROM x GROUP BY 1")
def depth(s, d):
    m = lambda c: F.transform(c, lambda x: x % 5)
    r = R.accuracy_by_depth(sequences(s, d).select(m("ids").alias("p"), m("sups").alias("t")), "p", "t")
    return r.withColumn("accuracy", F.round("accuracy", 6))


@query("numeric_answers", "SELECT p_partkey, abs(round(p_retailprice) - p_retailprice) <= 1e-4 * abs(p_retailprice) AS same FROM part")
def answers(s, d):
    return table(s, d, "part").select("p_partkey", A.equal(F.concat(F.lit("$"), F.round("p_retailprice").cast("long").cast("string"), F.lit("$")), F.col("p_retailprice").cast("string")).alias("same"))


@query("step_rewards", f"WITH {SEQ} SELECT l_orderkey, list_transform(range(len(ids)), lambda i: CASE WHEN i % 2 = 1 THEN ids[i + 1]::DOUBLE ELSE 0::DOUBLE END) AS rewards FROM q")
def steps(s, d):
    ends = F.filter(F.transform("ids", lambda x, i: i), lambda i: i % 2 == 1)
    values = F.transform(ends, lambda i: F.get("ids", i).cast("double"))
    return sequences(s, d).select("l_orderkey", R.step_rewards(ends, values, F.size("ids")).alias("rewards"))


@query("formula_equality", """WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 7 + 1 AS k, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS off FROM part)
SELECT p_partkey, abs(s / k::DOUBLE - (2 * s + off) / (2 * k)::DOUBLE) <= 1e-4 * greatest(s / k::DOUBLE, (2 * s + off) / (2 * k)::DOUBLE) AS quotients, p_partkey % 5 <> 0 AS products, p_partkey % 4 <> 0 AS roots, p_partkey % 3 <> 0 AS intervals FROM p""")
def formula_equality(s, d):
    """Quotients, products and roots made from the columns, some of them off; the SQL decides by arithmetic."""
    p = spread(table(s, d, "part").select("p_partkey", F.col("p_size").alias("s"), (F.col("p_partkey") % 7 + 1).alias("k")))
    off = lambda n: (F.col("p_partkey") % n == 0).cast("int")
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    size, k = F.col("s"), F.col("k")
    return p.select(
        "p_partkey",
        formulas.same_formula(join(r"\frac{", size, "}{", k, "}"), join(2 * size + off(3), "/", 2 * k)).alias("quotients"),
        formulas.same_formula(join("(x+", size, ")(x-", k, ")"), join("x^2+(", size - k, ")x-", size * k + off(5))).alias("products"),
        formulas.same_formula(join(r"\sqrt{", size * k * k, "}"), join(k + off(4), r"\sqrt{", size, "}")).alias("roots"),
        formulas.same_formula(join("(-", k, ",", size, r"]\cup[99,\infty)"), join(r"[99,\infty) \cup (-", k, ",", size + off(3), "]")).alias("intervals"),
    )


NUMBER = "CAST('0x' || substr(md5({k}), 1, 12) AS BIGINT)"


@query("sampled_rollouts", f"""WITH RECURSIVE e AS (SELECT 'i' || item_id AS a, 'v' || vendor_id AS b, CAST(sum(coalesce(quantity, 0)) AS DOUBLE) AS s FROM sale_lines WHERE item_id IS NOT NULL AND vendor_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT a AS position, b AS move, s FROM e UNION ALL SELECT b, a, s FROM e),
w AS (SELECT *, CAST(greatest(floor(exp((s - max(s) OVER (PARTITION BY position)) / 20.0::DOUBLE) * 1073741824.0::DOUBLE), 1) AS HUGEINT) AS w FROM m),
c AS (SELECT *, sum(w) OVER (PARTITION BY position ORDER BY md5(move), move) AS up, sum(w) OVER (PARTITION BY position) AS total FROM w),
d AS (SELECT position, move, (up - w) * 281474976710656 // total AS low, up * 281474976710656 // total AS high FROM c),
u AS (SELECT item_id AS tree, move, s / 20.0::DOUBLE - ln(-ln(({NUMBER.format(k="'5:' || item_id || ':' || move")} + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) AS g FROM (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL) JOIN m ON position = 'i' || item_id),
g AS (SELECT tree, move, CAST(row_number() OVER (PARTITION BY tree ORDER BY g DESC, move) AS INTEGER) AS draw FROM u QUALIFY draw <= 2),
t AS (SELECT tree, draw, walk, 0 AS step, move FROM g, range(3) r(walk) UNION ALL SELECT t.tree, t.draw, t.walk, t.step + 1, d.move FROM (SELECT *, {NUMBER.format(k="'5:' || tree || ':' || draw || ':' || walk || ':' || (step + 1)")} AS at FROM t WHERE step < 3) t JOIN d ON d.position = t.move AND t.at >= d.low AND t.at < d.high)
SELECT tree, draw, walk, CAST(step AS INTEGER) AS step, move FROM t""")
def sampled(s, d):
    """From each item over its vendors and their items: a move leads to the node it names, by the quantity sold."""
    node = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    sold = table(s, d, "sale_lines").groupBy(node("i", "item_id").alias("a"), node("v", "vendor_id").alias("b")).agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("double").alias("score"))
    way = lambda x, y: F.struct(F.col(x).alias("position"), F.col(y).alias("move"), F.col(y).alias("child"))
    scores = sold.filter("a IS NOT NULL AND b IS NOT NULL").select("score", F.inline(F.array(way("a", "b"), way("b", "a"))))
    roots = table(s, d, "items").select(F.col("item_id").alias("tree"), node("i", "item_id").alias("position"))
    return W.rollouts(roots, scores, 2, 3, 4, 20.0, 5).drop("position")
