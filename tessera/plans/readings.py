"""Queries over rule sets that answers state: read strictly and compared with the policy they should state on every request of a closed universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readings as R
from ..operators import equivalence as E
from ..schemas import CONDITION, RULE, SCOPE, VALUE, bool_value, int_value, text_value
from ..sources.storage import written
from . import fixtures as X

_ACTIONS = ("audit", "return", "view")
_CONTEXT = (("quantity", "int"), ("status", "str"), ("urgent", "bool"))


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A policy's entities, attributes, actions and context keys for each nation: its customers in segments, and all brands with their makers."""
    customer, part = X.table(spark, sf_dir, "customer"), X.table(spark, sf_dir, "part")
    nations = customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("policy_id")).distinct()
    named = lambda kind, c: F.concat(F.lit(f"{kind}::"), c.cast("string"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{VALUE}>"))
    key, segment = named("customer", F.col("c_custkey")), named("segment", F.col("c_mktsegment"))
    people = customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("policy_id"), key.alias("key"), F.lit("customer").alias("type"), F.array(key, segment).alias("groups"), F.create_map(F.lit("balance"), int_value(F.floor("c_acctbal"))).alias("attrs"))
    segments = people.select("policy_id", F.get("groups", F.lit(1)).alias("key"), F.lit("segment").alias("type")).distinct().select("*", F.array("key").alias("groups"), none.alias("attrs"))
    brand, maker = named("brand", F.col("p_brand")), named("maker", F.substring("p_brand", 1, 7))
    brands = part.select("p_brand").distinct().select(brand.alias("key"), F.lit("brand").alias("type"), F.array(brand, maker).alias("groups"), F.create_map(F.lit("rank"), int_value(F.regexp_extract("p_brand", r"(\d+)$", 1))).alias("attrs"))
    makers = part.select(maker.alias("key")).distinct().select("key", F.lit("maker").alias("type"), F.array("key").alias("groups"), none.alias("attrs"))
    things = nations.join(F.broadcast(brands.unionAll(makers)))  # 25 nations with 25 brands and 5 makers
    entities = people.unionAll(segments).unionAll(things)
    kinds = [("customer", "balance", "int"), ("brand", "rank", "int")]
    attrs = nations.select("policy_id", F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.lit(a).alias("attr"), F.lit(k).alias("kind")) for t, a, k in kinds))).alias("x")).select("policy_id", "x.*")
    actions = nations.select("policy_id", F.explode(F.array(*map(F.lit, _ACTIONS))).alias("action"))
    context = nations.select("policy_id", F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.lit(k).alias("kind")) for a, k in _CONTEXT))).alias("x")).select("policy_id", "x.*")
    return entities, attrs, actions, context


def _rule(name: str, effect: str, principal: Column, actions: tuple[str, ...], resource: Column, *conditions: Column) -> Column:
    return F.struct(F.lit(name).alias("rule_id"), F.lit(effect).alias("effect"), principal.alias("principal"), F.array(*map(F.lit, actions)).alias("actions"), resource.alias("resource"), F.array(*conditions).cast(f"array<{CONDITION}>").alias("conditions")).cast(RULE)


def _scope(kind: str, of: tuple[str, Column] | None = None, typed: str | None = None) -> Column:
    entity = F.struct(F.lit(of[0]).alias("type"), of[1].alias("id")) if of else F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), entity.alias("entity"), F.lit(typed).alias("type")).cast(SCOPE)


def _test(left: str, op: Column | str, right: Column | str) -> Column:
    ref = lambda x: F.struct(F.lit(x.split(".")[0]).alias("subject"), F.lit(x.split(".")[1]).alias("attr"), F.lit(None).alias("value"))
    value = ref(right) if isinstance(right, str) else F.struct(F.lit(None).alias("subject"), F.lit(None).alias("attr"), right.alias("value"))
    return F.struct(ref(left).alias("left"), (F.lit(op) if isinstance(op, str) else op).alias("op"), value.alias("right")).cast(CONDITION)


def _gold(limit: Column, segment: Column, maker: Column, op: str = "<", than: str = ">=", typed: Column | None = None) -> list[Column]:
    """The rules of a nation, or what one of them may become in a reading."""
    quantity = int_value(limit) if typed is None else typed
    return [
        _rule("r1", "permit", _scope("is_in", ("segment", segment), "customer"), ("audit", "view"), _scope("is_in", ("maker", maker), "brand"), _test("context.quantity", op, quantity)),
        _rule("r2", "forbid", _scope("any"), ("audit",), _scope("is", typed="brand"), _test("resource.rank", ">=", int_value(F.lit(40))), _test("context.status", "==", text_value(F.lit("F")))),
        _rule("r3", "permit", _scope("is", typed="customer"), ("return", "view"), _scope("is", typed="brand"), _test("principal.balance", than, "resource.rank"), _test("context.urgent", "==", bool_value(F.lit(True)))),
    ]


def conversion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading of its nation's rules by each supplier, of ten kinds: exact, equivalent, shifted, with a rule missing, ill-formed, refused, unreadable or empty."""
    customer = X.table(spark, sf_dir, "customer")
    each = customer.groupBy("c_nationkey").agg((F.count(F.lit(1)) % 12 + 3).alias("limit"), F.min("c_mktsegment").alias("segment"))
    maker = F.concat(F.lit("Brand#"), (F.col("c_nationkey") % 5 + 1).cast("string"))
    nations = each.select("c_nationkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("policy_id"), "limit", "segment", maker.alias("maker"))
    limit, segment, maker = F.col("limit"), F.col("segment"), F.col("maker")
    gold = _gold(limit, segment, maker)
    kinds = [gold, _gold(limit - 1, segment, maker, op="<="), _gold(limit + 1, segment, maker), [gold[0], gold[2]], _gold(limit, segment, maker, than=">"), _gold(limit, F.lit("NOWHERE"), maker), _gold(limit, segment, maker, typed=text_value(limit))]
    every = written(nations.select("c_nationkey", "policy_id", F.array(*(F.array(*rules) for rules in kinds)).alias("kinds")))
    k = F.col("s_suppkey") % 10
    stated = X.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", k.alias("k")).join(every, F.col("s_nationkey") == F.col("c_nationkey"))
    # The first kind has other ids, so another order, and stands in a code fence; the last three state no rules, or none at all.
    told = F.get("kinds", F.least(k, F.lit(len(kinds) - 1)).cast("int"))
    own = F.when(k == 0, F.transform(told, lambda r: r.withField("rule_id", F.translate(r["rule_id"], "123", "zyx")))).otherwise(told)
    text = R.as_reading(F.col("own"))
    other = F.element_at(F.array(*map(F.lit, ("I cannot restate these rules.", "rules: none", '{"rules": []}'))), (F.col("k") - 6).cast("int"))
    answers = written(stated.withColumn("own", own).select("policy_id", "s_suppkey", F.when(F.col("k") > 6, other).when(F.col("k") == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text).alias("answer")))
    # Texts are small and reading one is not, so tasks get them by number; suppliers who say the same are read once.
    texts = answers.select("answer").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "answer")
    parsed = written(texts.select("answer", R.read_reading(F.col("answer")).alias("x")).select("answer", "x.category", "x.rules"))
    read = answers.join(parsed, "answer").select("policy_id", "s_suppkey", "category", "rules")
    wanted = every.select("policy_id", F.get("kinds", F.lit(0)).alias("rules"))
    scored = E.score_readings(wanted, read, *_world(spark, sf_dir), ["customer"], ["brand"])
    return scored.select("s_suppkey", "category", "valid", "problem", "exact", "equivalent", "requests", "differ", "over", "under", "principal", "action", "resource", "context")


SQL = {
    "conversion_scores": """WITH n AS (SELECT c_nationkey AS nk, count(*) % 12 + 3 AS l, min(c_mktsegment) AS seg, 'Brand#' || (c_nationkey % 5 + 1) AS maker FROM customer GROUP BY c_nationkey),
s AS (SELECT s_suppkey, s_suppkey % 10 AS v, n.* FROM supplier JOIN n ON s_nationkey = nk),
b AS (SELECT DISTINCT p_brand, substr(p_brand, 1, 7) AS mfgr, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS rank FROM part),
ok AS (SELECT * FROM s WHERE v IN (0, 1, 2, 3, 4, 9)),
q AS (SELECT *, unnest(CASE v WHEN 1 THEN [l - 2, l - 1, l, l + 1] WHEN 2 THEN [l - 1, l, l + 1, l + 2] ELSE [l - 1, l, l + 1] END) AS quantity FROM ok),
u AS (SELECT q.*, c_custkey, c_mktsegment, floor(c_acctbal) AS balance, p_brand, mfgr, rank, action, status, urgent FROM q JOIN customer ON c_nationkey = nk, b, (VALUES ('audit'), ('return'), ('view')) a(action), (VALUES ('F'), ('__unseen__')) t(status), (VALUES (false), (true)) g(urgent)),
m AS (SELECT *, c_mktsegment = seg AND action IN ('audit', 'view') AND mfgr = maker AS s1, action = 'audit' AND rank >= 40 AND status = 'F' AS f, action IN ('return', 'view') AND urgent AS s3 FROM u),
d AS (SELECT *, (s1 AND quantity < l OR s3 AND balance >= rank) AND NOT f AS want,
  CASE v WHEN 0 THEN (s1 AND quantity < l OR s3 AND balance >= rank) AND NOT f WHEN 1 THEN (s1 AND quantity <= l - 1 OR s3 AND balance >= rank) AND NOT f WHEN 2 THEN (s1 AND quantity < l + 1 OR s3 AND balance >= rank) AND NOT f
    WHEN 3 THEN s1 AND quantity < l OR s3 AND balance >= rank WHEN 4 THEN (s1 AND quantity < l OR s3 AND balance > rank) AND NOT f ELSE false END AS got FROM m),
g AS (SELECT s_suppkey, count(*) AS requests, count(*) FILTER (want != got) AS differ, count(*) FILTER (got AND NOT want) AS over, count(*) FILTER (want AND NOT got) AS under FROM d GROUP BY s_suppkey),
w AS (SELECT * FROM (SELECT s_suppkey, 'customer::' || c_custkey AS principal, action, 'brand::' || p_brand AS resource, 'quantity=' || quantity || ',status=' || status || ',urgent=' || urgent AS context,
  row_number() OVER (PARTITION BY s_suppkey ORDER BY 'customer::' || c_custkey, action, 'brand::' || p_brand, quantity, status = '__unseen__', urgent) AS r FROM d WHERE want != got) WHERE r = 1)
SELECT s.s_suppkey, CASE v WHEN 7 THEN 'refusal' WHEN 8 THEN 'parse_failure' ELSE 'rules' END AS category, v IN (0, 1, 2, 3, 4, 9) AS valid, CASE v WHEN 5 THEN 'unknown entity' WHEN 6 THEN 'mismatched types' END AS problem,
  v = 0 AS exact, coalesce(differ = 0, false) AS equivalent, requests, differ, over, under, principal, action, resource, context
FROM s LEFT JOIN g USING (s_suppkey) LEFT JOIN w USING (s_suppkey)""",
}

QUERIES = {f.__name__: f for f in (conversion_scores,)}
