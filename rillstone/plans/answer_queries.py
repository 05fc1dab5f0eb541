"""Final answers, training rows and retrieved passages on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import final_answers as N
from ..functions import moves as M
from ..operators import training_rows as R
from ..sources.loaders import passages
from ..sources.tables import spread, table

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _replaced(c: str) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    for before, after in [*N.SUBSTITUTIONS, *((w, "") for w in N.REMOVED)]:
        c = f"replace({c}, {quoted(before)}, {quoted(after)})"
    return c


ANSWER = "'the answer = \\text{' || p_name || '} $' || p_size || ',' || p_partkey || '$ \\frac12 inches \\sqrt3 \\mbox{m} ' || p_brand"


@query("normal_answers", f"""WITH a AS (SELECT p_partkey, {_replaced("substr(t, length(t) - position('=' IN reverse(t)) + 2)")} AS t FROM (SELECT p_partkey, {ANSWER} AS t FROM part)), b AS (SELECT p_partkey, regexp_replace(t, '(.*?)([$])(.*?)([$])(.*)', '$\\3$', 'g') AS t FROM a),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\\\\text\\{{)(.*?)(\\}})', '\\2', 'g'), '(\\\\textbf\\{{)(.*?)(\\}})', '\\2', 'g'), '(\\\\overline\\{{)(.*?)(\\}})', '\\2', 'g'), '(\\\\boxed\\{{)(.*)(\\}})', '\\2', 'g') AS t FROM b),
e AS (SELECT p_partkey, replace(regexp_replace(regexp_replace(t, '(frac)([^{{])(.)', 'frac{{\\2}}{{\\3}}', 'g'), '(sqrt)([^{{])', 'sqrt{{\\2}}', 'g'), '$', '') AS t FROM c) SELECT p_partkey, trim(CASE WHEN regexp_matches(replace(t, ',', ''), '^[0-9]+$') THEN replace(t, ',', '') ELSE t END) AS answer FROM e""")
def normal(s, d):
    text = F.concat(F.lit("the answer = \\text{"), "p_name", F.lit("} $"), F.col("p_size").cast("string"), F.lit(","), F.col("p_partkey").cast("string"), F.lit("$ \\frac12 inches \\sqrt3 \\mbox{m} "), "p_brand")
    return table(s, d, "part").select("p_partkey", N.normalised(text).alias("answer"))


@query("boxed_answers", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE '{' || p_size || '}{' || p_name || '}' END AS answer, CASE WHEN p_size % 4 <> 0 AND p_size % 2 = 0 THEN 1 ELSE -1 END AS strict FROM part")
def boxed(s, d):
    body = F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit("}{"), F.col("p_name"), F.lit("}"))
    text = F.concat(F.lit("x" * 120 + " \\boxed{old} so \\boxed{"), body, F.when(F.col("p_size") % 4 == 0, "").otherwise("} done"))
    gold = F.when(F.col("p_size") % 2 == 0, body).otherwise("none")
    return spread(table(s, d, "part").select("p_partkey", "p_size", "p_name")).select("p_partkey", N.boxed(text).alias("answer"), N.strict_box(text, gold).alias("strict"))


@query("answer_lines", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '[INVALID]' ELSE p_name END AS answer, p_size % 3 <> 0 AND p_size % 2 = 0 AS is_right FROM part")
def answer_lines(s, d):
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("Answer: no\nthen ANSWER : "), F.col("p_name"), F.lit("\nbye")))
    gold = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x = "), F.col("p_name"))).otherwise("q")
    return table(s, d, "part").select("p_partkey", N.last_answer_line(text).alias("answer"), N.verified(text, gold).alias("is_right"))


@query("weighted_answers", "SELECT p_partkey, round(0.9::DOUBLE * (p_size % 2 = 0)::INT + 0.1::DOUBLE * (p_size % 3 = 0)::INT, 6) AS score FROM part")
def weighted(s, d):
    gold = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") * 3 + 1).cast("string")
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "<think>a</think> ").otherwise("a "), F.lit("\\boxed{"), F.col("p_partkey").cast("string"), F.lit("}"))
    return spread(table(s, d, "part").select("p_partkey", "p_size")).select("p_partkey", F.round(N.weighted(text, gold), 6).alias("score"))


@query("answers_after_thought", "SELECT p_partkey, p_size % 3 = 0 AND p_size % 2 = 0 AS is_right FROM part")
def after_thought(s, d):
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "<think>\\boxed{0}</think> ").otherwise("\\boxed{0} "), F.lit("\\boxed{"), F.col("p_partkey").cast("string"), F.lit("}"))
    golds = F.array(F.lit("-1"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\\boxed{"), F.col("p_partkey").cast("string"), F.lit("}"))).otherwise("-2"))
    return spread(table(s, d, "part").select("p_partkey", "p_size")).select("p_partkey", N.after_thought_right(text, golds).alias("is_right"))


@query("listed_moves", "SELECT s_suppkey, (list_filter(string_split(coalesce(s_name, '') || ', ,' || s_nationkey, ','), lambda x: trim(x) <> ''))[1] AS first, contains(s_name, '<T>') AS tagged FROM supplier")
def listed(s, d):
    t = F.concat(F.coalesce("s_name", F.lit("")), F.lit(", ,"), F.col("s_nationkey").cast("string"))
    return table(s, d, "supplier").select("s_suppkey", M.first_listed(t).alias("first"), M.has_both_tags(F.col("s_name")).alias("tagged"))


# rows for training: prompts and responses are lists of a customer's and an order's numbers


SEQ = "q AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, list(l_suppkey % 10 ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem GROUP BY 1)"


def sequences(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("s"))
    return g.select("l_orderkey", F.col("s.l_partkey").alias("p"), F.transform(F.col("s.l_suppkey"), lambda x: x % 10).alias("r"))


@query("thought_aware_rows", f"""WITH {SEQ}, a AS (SELECT l_orderkey, p[1:len(p) - 1] AS h, r[2:] AS t FROM q), b AS (SELECT *, coalesce(t[1] = 3, false) AS th FROM a), c AS (SELECT l_orderkey, h, th, CASE WHEN NOT th AND coalesce(t[-1] = 7, false) THEN t[1:len(t) - 1] ELSE t END AS t FROM b),
e AS (SELECT l_orderkey, (h || t)[1:6] AS ids, least(len(h) + th::INT, CASE WHEN len(h) + len(t) > 6 THEN 5 ELSE len(h) + 1 END) AS known FROM c) SELECT l_orderkey, ids[1:len(ids) - 1] AS inputs, list_transform(ids[2:], lambda x, i: CASE WHEN known > 1 AND i - 1 < known - 1 THEN -100 ELSE x END) AS labels FROM e""")
def thought_rows(s, d):
    r = R.thought_aware_row(F.col("p"), F.col("r"), 6, 3, 7)
    return sequences(s, d).select("l_orderkey", r.alias("x")).select("l_orderkey", "x.inputs", "x.labels")


@query("chat_rows", f"WITH {SEQ}, a AS (SELECT l_orderkey, p || r AS j, len(p) AS n, len(p) + len(r) AS m FROM q) SELECT l_orderkey, list_resize(j[1:8], 8, 0::BIGINT) AS input_ids, list_transform(range(8), lambda i: (i < m)::INT) AS attention_mask, list_transform(range(8), lambda i: CAST(least(i, least(m, 8) - 1) AS INT)) AS position_ids, list_transform(range(8), lambda i: CASE WHEN (n > 1 AND i < least(n, 8) - 1) OR i = least(m, 8) - 1 OR i >= m THEN 0 ELSE 1 END) AS loss_mask FROM a")
def chat(s, d):
    r = R.chat_row(F.col("p"), F.col("r"), 8)
    return sequences(s, d).select("l_orderkey", r.alias("x")).select("l_orderkey", "x.*")


@query("tokenisation_check", "SELECT conv_id, turn, NOT contains(text, '  ') AND text = trim(text) AS same FROM conversations")
def check(s, d):
    t = table(s, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"), F.filter(F.split("text", " "), lambda w: w != "").alias("b"))
    return R.checked_tokens(t, "a", "b", "same").select("conv_id", "turn", "same")


@query("passages", "WITH g AS (SELECT item_id // 5 AS k, list(text ORDER BY item_id) AS l FROM (SELECT item_id, replace(text, ' ', chr(10)) AS text FROM benchmark) GROUP BY 1) SELECT k, trim(array_to_string(list_transform(l, lambda c, i: 'Doc ' || i || ' (Title: ' || split_part(c, chr(10), 1) || ')' || chr(10) || CASE WHEN contains(c, chr(10)) THEN substr(c, strpos(c, chr(10)) + 1) ELSE '' END), chr(10) || chr(10))) AS t FROM g")
def retrieved(s, d):
    b = table(s, d, "benchmark").select(F.expr("item_id div 5").alias("k"), F.struct("item_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("t")).alias("x"))
    return b.groupBy("k").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("l")).select("k", passages(F.col("l")).alias("t"))


@query("merged_turns", "WITH c AS (SELECT *, CASE WHEN role = 'user' AND lag(role) OVER w = 'user' THEN 0 ELSE 1 END AS new FROM (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 AND role <> 'system' THEN 'user' ELSE role END AS role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS part FROM c) SELECT conv_id, CAST(part AS INT) AS turn, role, string_agg(text, chr(10) ORDER BY p.turn) AS text FROM p GROUP BY conv_id, part, role")
def merged(s, d):
    role = F.when((F.col("turn") % 3 > 0) & (F.col("role") != "system"), "user").otherwise(F.col("role"))
    return R.merged_turns(table(s, d, "conversations").withColumn("role", role).select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text", "user")
