"""Queries of audits, hashes and run metrics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import matching as MA
from ..operators import metrics as M
from ..operators import policy as P
from ..operators import stats as S
from . import fixtures as X

REPLICATES = 4_000
_R = lambda c, name=None: F.round(c, 6).alias(name or c)


def matched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pairs, return flags as conditions: which lack one, have lines of one twice, or ship by more than one status."""
    lines = X.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 0, F.col("l_suppkey") % 3).alias("third"))
    found = A.matched_groups(lines, "l_suppkey", "l_returnflag", ["A", "N", "R", "X"], {"status": F.col("l_linestatus"), "third": F.col("third")})
    return found.groupBy("problem", "item").agg(F.count(F.lit(1)).alias("n"))


def role_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pairs told in two orders; every fifth lacks one, every seventh changes its segment, every third does not swap."""
    own = X.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", F.col("c_nationkey").cast("string").alias("nation"))
    rows = own.withColumn("role", F.explode(F.array(F.lit("system"), F.lit("user")))).where("c_custkey % 5 != 0 or role = 'system'")
    k, user = F.col("c_custkey"), F.col("role") == "user"
    rows = rows.select("c_custkey", "role", F.when(user & (k % 7 == 0), "changed").otherwise(F.col("c_mktsegment")).alias("question"), F.when(user & (k % 3 != 0), F.col("nation")).otherwise(F.col("c_name")).alias("above"), F.when(user & (k % 3 != 0), F.col("c_name")).otherwise(F.col("nation")).alias("below"))
    return A.role_swaps(rows, "c_custkey", "role", "system", "user", ["question"], ("above", "below")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.unique_ids(X.table(spark, sf_dir, "conversations"), "conv_id", "role", ["system", "user"])
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", F.lit(1.0).alias("one"))
    return A.independence(lines, ["l_quantity", "l_discount", "l_extendedprice", "one"], 0.1).select("a", "b", F.round("r", 6).alias("r"), "passed")


def side_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents")
    return A.balance(docs, ["lang"], {"even": F.col("doc_id") % 2 == 0, "odd": F.col("doc_id") % 2 == 1})


def swap_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = X.table(spark, sf_dir, "customer").where("c_nationkey % 4 != 1").select(F.col("c_nationkey").alias("nation"))
    suppliers = X.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return A.swap_axis(customers, suppliers, "nation")


def scope_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity types that the rules of the sales policy can reach."""
    entities, parents = X.sales_entities(spark, sf_dir)
    rules, above = X.sales_rules(spark), P.closure(parents)
    one = lambda side: A.scope_types(rules, entities, above, side).select(F.lit(side).alias("side"), "rule_id", "type")
    return one("principal").unionAll(one("resource"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import generate as G

    ids = X.table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("policy_id")).distinct()
    return G.draw_rules(ids, ["AMERICA", "ASIA"], ["audit", "view"], "nation", "part", "size", 50, seed=6)


def semantic_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random policies, the same with rule ids and action order changed, and the same with one effect changed: which hashes stay."""
    rules = _drawn(spark, sf_dir)
    entities = rules.select("policy_id", F.concat(F.lit("nation::"), F.split("policy_id", "/")[1]).alias("key"), F.lit("nation").alias("type")).distinct()
    r = F.col("rule")
    renamed = rules.withColumn("rule", r.withField("rule_id", F.concat(F.lit("x"), r["rule_id"])).withField("actions", F.reverse(r["actions"])))
    changed = rules.withColumn("rule", r.withField("effect", F.when(r["rule_id"] == "r0", F.when(r["effect"] == "permit", "forbid").otherwise("permit")).otherwise(r["effect"])))
    h = lambda df, name: A.semantic_hash(df, entities).withColumnRenamed("sha256", name)
    both = h(rules, "a").join(h(renamed, "b"), "policy_id").join(h(changed, "c"), "policy_id")
    return both.agg(F.count(F.lit(1)).alias("policies"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") != F.col("c")).alias("changed"))


def repeated_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose condition is stated one to three times."""
    rules = _drawn(spark, sf_dir)
    times = F.length("policy_id") % 3 + 1
    thrice = rules.withColumn("rule", F.col("rule").withField("conditions", F.flatten(F.array_repeat(F.col("rule.conditions"), times))))
    back = A.distinct_conditions(thrice)
    same = back.join(rules.select("policy_id", F.col("rule").alias("was")), (F.col("was.rule_id") == F.col("rule.rule_id")) & (back["policy_id"] == rules["policy_id"])).where("rule = was")
    return same.groupBy("n_dropped").agg(F.count(F.lit(1)).alias("rules"))


def sum_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halves of each vector as logits of two places, with targets from its label."""
    own = X.table(spark, sf_dir, "embeddings")
    logits = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    first = (F.col("label") % 32).cast("int")
    lp = A.sum_logprob(logits, F.array(F.lit(0), first, ((F.col("label") + 5) % 32).cast("int")))
    return own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lp), 5).alias("logprob"))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("step"))
    return events.groupBy("step").agg(F.count(F.lit(1)).alias("n")).select("step", "n", F.round(A.learning_rate(F.col("step"), 900, 100, 0.5), 9).alias("rate"))


def _conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.answers(spark, sf_dir)
    t = F.col("tokens")
    return rows.select("world_id", "rendering", F.when(F.col("category").isin("correct", "incorrect"), "ir").otherwise(F.col("category")).alias("category"), (t % 10 != 0).alias("valid"), (t % 3 == 0).alias("exact"), F.when(F.col("category") != "refusal", t % 4 != 1).alias("equivalent"), t.alias("prompt_tokens"), F.when(t % 2 == 0, t / 2).alias("output_tokens"))


def conversion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("readable", "valid", "exact", "equivalent", "wrong_if_read", "prompt_tokens", "output_tokens")
    return A.conversion_metrics(_conversions(spark, sf_dir), ["rendering"]).select("rendering", "conversions", *(_R(n) for n in names))


def _rates(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    names = {"accuracy": M.answer_predicates()["accuracy"]}
    return M.macro(M.per_world(X.answers(spark, sf_dir, run), ["rendering"], names), ["rendering"], ["accuracy"])


def floor_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.floor_ceiling(_rates(spark, sf_dir, "base"), "accuracy", "json").select(_R("fixed"), _R("best"), _R("worst"), _R("ceiling"))


def quantization_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.largest_change(_rates(spark, sf_dir, "base"), _rates(spark, sf_dir, "arm"), "accuracy")
    return found.select("rendering", _R("largest"), _R("base_gap"), "exceeds")


def boot_balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the balanced accuracy of answers, worlds redrawn; answers without a value are wrong."""
    rows = X.answers(spark, sf_dir).withColumn("given", F.coalesce("value", F.lit("none")))
    means = A.bootstrap_balanced_accuracy(rows, "label", "given", S.weights(rows, "world_id", REPLICATES, 12), "world_id")
    return S.interval(means.withColumn("mean", F.round("mean", 12)), []).select(_R("low"), _R("high"))


_RATES = f"""WITH {X.answers_sql()}, {X.answers_sql("arm", "arm")},
w AS (SELECT rendering, world_id, avg((category = 'correct')::INT) AS a FROM ans GROUP BY ALL), v AS (SELECT rendering, world_id, avg((category = 'correct')::INT) AS a FROM arm GROUP BY ALL),
b AS (SELECT rendering, avg(a) AS a FROM w GROUP BY rendering), m AS (SELECT rendering, avg(a) AS a FROM v GROUP BY rendering)"""

def prompt_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against a treated copy: a note put in, in every third conversation a line taken out, in every fifth the last line changed. Lines kept, removed and added, and whether only notes differ."""
    own = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), "\n").alias("a"))
    k = F.col("turn") % F.size("a")
    cut = F.when(F.col("conv_id") % 3 == 0, F.filter("a", lambda x, i: i != k)).otherwise(F.col("a"))
    noted = own.withColumn("c", cut).withColumn("c", F.concat(F.slice("c", 1, 1), F.array(F.concat(F.lit("NOTE: "), F.col("conv_id").cast("string"))), F.when(F.size("c") > 1, F.slice("c", F.lit(2), F.size("c"))).otherwise(F.array())))
    last = F.when(F.col("conv_id") % 5 == 0, F.concat(F.slice("c", F.lit(1), F.size("c") - 1), F.array(F.upper(F.element_at("c", -1))))).otherwise(F.col("c"))
    return MA.compared(noted.withColumn("b", last), F.col("a"), F.col("b"), "^NOTE: ").select("conv_id", "turn", "kept", "removed", "added", "matched")


SQL = {
    "prompt_edits": """WITH RECURSIVE o AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS a FROM conversations),
c AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN [a[i] FOR i IN range(1, len(a) + 1) IF i - 1 != turn % len(a)] ELSE a END AS c FROM o),
n AS (SELECT conv_id, turn, a, list_concat(list_concat(c[1:1], ['NOTE: ' || conv_id]), c[2:]) AS b FROM c),
p AS (SELECT conv_id, turn, a, CASE WHEN conv_id % 5 = 0 THEN list_concat(b[1:len(b) - 1], [upper(b[len(b)])]) ELSE b END AS b FROM n),
w AS (SELECT conv_id, turn, a, b, list_transform(range(0, len(a) + 1), lambda x: 0::BIGINT) AS r, 0 AS j FROM p
  UNION ALL SELECT conv_id, turn, a, b, list_concat([0::BIGINT], list_transform(range(1, len(a) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda x: greatest(r[x + 1], CASE WHEN a[x] = b[j + 1] THEN r[x] + 1 ELSE 0 END))))), j + 1 FROM w WHERE j < len(b)),
m AS (SELECT conv_id, turn, r[len(r)] AS kept FROM w WHERE j = len(b))
SELECT conv_id, turn, kept, len(a) - kept AS removed, len(b) - kept AS added, len(a) = kept AND len(list_filter(b, lambda x: x NOT LIKE 'NOTE: %')) = kept AS matched FROM p JOIN m USING (conv_id, turn)""",
    "matched_groups": """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'missing' AS problem, f AS item, count(*) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem) s, (VALUES ('A'), ('N'), ('R'), ('X')) v(f) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l_suppkey = s.l_suppkey AND c.l_returnflag = f) GROUP BY f
UNION ALL SELECT 'repeated', l_returnflag, count(*) FROM c WHERE n > 1 GROUP BY l_returnflag
UNION ALL SELECT 'varies', 'status', count(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linestatus) > 1) HAVING count(*) > 0""",
    "role_swaps": """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'missing role' WHEN c_custkey % 7 = 0 THEN 'content differs' WHEN c_custkey % 3 = 0 THEN 'places not swapped' END AS problem FROM customer) WHERE problem IS NOT NULL GROUP BY problem""",
    "unique_ids": """WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role NOT IN ('system', 'user')) AS odd FROM conversations GROUP BY conv_id)
SELECT 'repeated' AS problem, count(*) AS n FROM c WHERE n > 1 HAVING count(*) > 0 UNION ALL SELECT 'unknown kind', count(*) FROM c WHERE odd > 0 HAVING count(*) > 0""",
    "independence": """WITH p AS (SELECT 'l_quantity' AS a, 'l_discount' AS b, corr(l_quantity, l_discount) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', 'l_extendedprice', corr(l_discount, l_extendedprice) FROM lineitem
  UNION ALL SELECT c, 'one', 0.0 FROM (VALUES ('l_quantity'), ('l_discount'), ('l_extendedprice')) v(c))
SELECT a, b, round(r, 6) AS r, abs(r) < 0.1 AS passed FROM p""",
    "side_balance": "SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS even, count(*) FILTER (doc_id % 2 = 1) AS odd, count(*) FILTER (doc_id % 2 = 0) = count(*) FILTER (doc_id % 2 = 1) AS balanced FROM documents GROUP BY lang",
    "swap_axis": """WITH p AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_nationkey % 4 != 1 GROUP BY ALL), r AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY ALL)
SELECT coalesce(p.nation, r.nation) AS nation, CASE WHEN p.n >= 2 THEN 'principals' WHEN r.n >= 2 THEN 'resources' END AS axis FROM p FULL JOIN r ON p.nation = r.nation""",
    "scope_types": """WITH t AS (SELECT unnest(['customer', 'nation', 'region', 'part', 'brand']) AS type)
SELECT 'principal' AS side, rule_id, type FROM (VALUES ('r2'), ('r3')) v(rule_id), t
UNION SELECT 'principal', 'r1', type FROM (VALUES ('region'), ('nation'), ('customer')) v(type) WHERE type = 'region' OR type = 'nation' AND EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
  OR type = 'customer' AND EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
UNION SELECT 'principal', 'r5', type FROM (VALUES ('nation'), ('customer')) v(type) WHERE type = 'nation' OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 3)
UNION SELECT 'principal', rule_id, 'customer' FROM (VALUES ('r4'), ('r6'), ('r7')) v(rule_id)
UNION SELECT 'resource', rule_id, type FROM (VALUES ('r4'), ('r5'), ('r7')) v(rule_id), t
UNION SELECT 'resource', rule_id, 'part' FROM (VALUES ('r1'), ('r3'), ('r6')) v(rule_id)
UNION SELECT 'resource', 'r2', type FROM (VALUES ('brand'), ('part')) v(type) WHERE type = 'brand' OR EXISTS (SELECT 1 FROM part WHERE substr(p_brand, 1, 7) = 'Brand#1')""",
    "semantic_hashes": "SELECT count(*) AS policies, count(*) AS same, count(*) AS changed FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)",
    "sum_logprobs": """WITH e AS (SELECT label, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS u, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT label, count(*) AS n, round(avg(u[CAST(label % 32 AS INTEGER) + 1] - ln(list_sum(list_transform(u, lambda x: exp(x)))) + v[CAST((label + 5) % 32 AS INTEGER) + 1] - ln(list_sum(list_transform(v, lambda x: exp(x))))), 5) AS logprob FROM e GROUP BY label""",
    "learning_rates": """SELECT event_id % 1000 AS step, count(*) AS n, round(CASE WHEN event_id % 1000 < 100 THEN 0.5 * (event_id % 1000 + 1) / 100 ELSE 0.25 * (1 + cos(pi() * least(1.0::DOUBLE, (event_id % 1000 - 100) / 800.0::DOUBLE))) END, 9) AS rate FROM events GROUP BY ALL""",
    "conversion_metrics": f"""WITH {X.answers_sql()}, c AS (SELECT *, category IN ('correct', 'incorrect') AS r, coalesce(CASE WHEN category != 'refusal' THEN tokens % 4 != 1 END, false) AS e FROM ans),
w AS (SELECT rendering, world_id, avg(r::INT) AS r, avg((tokens % 10 != 0)::INT) AS v, avg((tokens % 3 = 0)::INT) AS x, avg(e::INT) AS e, avg((NOT e)::INT) FILTER (r) AS bad FROM c GROUP BY ALL),
k AS (SELECT rendering, count(*) AS conversions, round(avg(tokens), 6) AS prompt_tokens, round(avg(CASE WHEN tokens % 2 = 0 THEN tokens / 2 END), 6) AS output_tokens FROM c GROUP BY rendering)
SELECT rendering, any_value(conversions) AS conversions, round(avg(r), 6) AS readable, round(avg(v), 6) AS valid, round(avg(x), 6) AS exact, round(avg(e), 6) AS equivalent, round(avg(bad), 6) AS wrong_if_read, any_value(prompt_tokens) AS prompt_tokens, any_value(output_tokens) AS output_tokens FROM w JOIN k USING (rendering) GROUP BY rendering""",
    "floor_ceiling": f"{_RATES} SELECT round(max(a) FILTER (rendering = 'json'), 6) AS fixed, round(max(a), 6) AS best, round(min(a), 6) AS worst, round((max(a) FILTER (rendering = 'json') - min(a)) / (max(a) - min(a)), 6) AS ceiling FROM b",
    "quantization_change": f"""{_RATES} SELECT arg_max(b.rendering, abs(m.a - b.a)) AS rendering, round(max(abs(m.a - b.a)), 6) AS largest, round(max(b.a) - min(b.a), 6) AS base_gap, max(abs(m.a - b.a)) >= max(b.a) - min(b.a) AS exceeds FROM b JOIN m ON b.rendering = m.rendering""",
}

QUERIES = {f.__name__: f for f in (prompt_edits, matched_groups, role_swaps, unique_ids, independence, side_balance, swap_axis, scope_types, semantic_hashes, repeated_conditions, sum_logprobs, learning_rates, conversion_metrics, floor_ceiling, quantization_change, boot_balanced_accuracy)}
