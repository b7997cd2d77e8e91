"""Stand-ins derived from the given tables: scored answers, requests with their entities, and conversations as episodes.

Each has a DataFrame form and, for the oracles, the same rules as SQL. Numbers that vary come from fixed arithmetic on ids, so
that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RENDERINGS, RULES, any_scope, attr, eq_scope, in_scope, int_value, is_scope, literal, rule, text_value

#: Salts of the stand-in runs: a baseline, an arm, and readings of the rules.
RUNS = {"base": 0, "arm": 17, "reading": 41}
#: Turns of the assistant after which an episode ends.
STEPS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str, run: str = "base") -> DataFrame:
    """world_id, assignment, instance, rendering, label, category, value, tokens: six renderings x two namings of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    kinds = F.explode(F.array(*(F.struct(F.lit(r).alias("rendering"), F.lit(k).alias("k")) for k, r in enumerate(RENDERINGS))))
    names = F.explode(F.array(*(F.struct(F.lit(a).alias("assignment"), F.lit(k).alias("a")) for k, a in enumerate(("orig", "swap")))))
    rows = docs.withColumn("r", kinds).withColumn("n", names)
    small = F.col("doc_id") % 100003
    h = (small * 7919 + F.col("r.k") * 104729 + F.col("n.a") * 15485863 + F.col("n_chars") * 31 + (small * small + F.col("r.k") * 13 + RUNS[run]) % 997 * 611953 + RUNS[run] * 7) % 1000
    rows = rows.select(F.col("source").alias("world_id"), "n.assignment", F.col("doc_id").alias("instance"), "r.rendering", F.when(F.col("n_chars") % 2 == 0, "allow").otherwise("deny").alias("label"), F.col("r.k").alias("k"), h.alias("h"))
    limit = 640 + 25 * F.col("k") + (60 if run != "base" else 0)
    category = F.when(F.col("h") < limit, "correct").when(F.col("h") < 900, "incorrect").when(F.col("h") < 930, "refusal").when(F.col("h") < 960, "abstain").otherwise("parse_failure")
    rows = rows.withColumn("category", category)
    other = F.when(F.col("label") == "allow", "deny").otherwise("allow")
    value = F.when(F.col("category") == "correct", F.col("label")).when(F.col("category") == "incorrect", other)
    return rows.withColumn("value", value).withColumn("tokens", 50 + F.col("h") % 200).drop("k", "h")


def answers_sql(run: str = "base", name: str = "ans") -> str:
    kinds = ", ".join(f"('{r}', {k})" for k, r in enumerate(RENDERINGS))
    return f"""{name}_h AS (
  SELECT source AS world_id, assignment, doc_id AS instance, rendering, k, CASE WHEN n_chars % 2 = 0 THEN 'allow' ELSE 'deny' END AS label,
    ((doc_id % 100003) * 7919 + k * 104729 + a * 15485863 + n_chars * 31 + (((doc_id % 100003) * (doc_id % 100003) + k * 13 + {RUNS[run]}) % 997) * 611953 + {RUNS[run] * 7}) % 1000 AS h
  FROM documents, (VALUES {kinds}) r(rendering, k), (VALUES ('orig', 0), ('swap', 1)) n(assignment, a)),
{name}_c AS (
  SELECT *, CASE WHEN h < 640 + 25 * k + {60 if run != "base" else 0} THEN 'correct' WHEN h < 900 THEN 'incorrect' WHEN h < 930 THEN 'refusal' WHEN h < 960 THEN 'abstain' ELSE 'parse_failure' END AS category
  FROM {name}_h),
{name} AS (
  SELECT world_id, assignment, instance, rendering, label, category, 50 + h % 200 AS tokens,
    CASE category WHEN 'correct' THEN label WHEN 'incorrect' THEN CASE label WHEN 'allow' THEN 'deny' ELSE 'allow' END END AS value
  FROM {name}_c)"""


#: The stand-in policy over customers and parts.
SALES_RULES = [
    rule("r1", "permit", in_scope("region", "EUROPE"), ["view", "return"], is_scope("part")),
    rule("r2", "permit", any_scope(), ["view"], in_scope("brand", "Brand#1"), (attr("context", "quantity"), "<", literal(30))),
    rule("r3", "forbid", any_scope(), ["return"], is_scope("part"), (attr("resource", "size"), ">=", literal(40))),
    rule("r4", "permit", in_scope("region", "ASIA", "customer"), ["audit", "view", "return"], any_scope(), (attr("principal", "segment"), "==", literal("BUILDING"))),
    rule("r5", "forbid", in_scope("nation", "3"), ["audit", "view"], any_scope(), (attr("context", "status"), "!=", literal("F"))),
    rule("r6", "permit", is_scope("customer"), ["audit"], is_scope("part"), (attr("principal", "balance"), ">", attr("resource", "size")), (attr("context", "quantity"), ">=", literal(10))),
    rule("r7", "permit", eq_scope("customer", "7"), ["audit", "return", "view"], any_scope()),
]


def sales_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sales", r) for r in SALES_RULES], RULES)


def sales_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities (policy_id, key, type) and direct membership (policy_id, key, parent): customers in nations in regions, parts in brands."""
    customer, nation, region, part = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "part"))
    e = lambda df, kind, id_: df.select(F.lit("sales").alias("policy_id"), F.concat(F.lit(f"{kind}::"), F.col(id_).cast("string")).alias("key"), F.lit(kind).alias("type"))
    brand = part.select(F.substring("p_brand", 1, 7).alias("brand")).distinct()
    entities = e(customer, "customer", "c_custkey").unionAll(e(nation, "nation", "n_nationkey")).unionAll(e(region, "region", "r_name")).unionAll(e(part, "part", "p_partkey")).unionAll(e(brand, "brand", "brand"))
    p = lambda df, key, parent: df.select(F.lit("sales").alias("policy_id"), key.alias("key"), parent.alias("parent"))
    k = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c).cast("string"))
    in_region = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    parents = p(customer, k("customer", "c_custkey"), k("nation", "c_nationkey")).unionAll(p(in_region, k("nation", "n_nationkey"), k("region", "r_name"))).unionAll(p(part, k("part", "p_partkey"), F.concat(F.lit("brand::"), F.substring("p_brand", 1, 7))))
    return entities, parents


def _subject(key: Column, kind: str, groups: Column, attrs: list[tuple[str, Column]]) -> Column:
    pairs = [x for n, v in attrs for x in (F.lit(n), v)]
    return F.struct(key.alias("key"), F.lit(kind).alias("type"), groups.alias("groups"), F.create_map(*pairs).alias("attrs"))


def sales_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order line: the customer acts on the part; what they do and in which context comes from the line."""
    from ..operators.policy import closure, with_groups

    entities, parents = sales_entities(spark, sf_dir)
    grouped = with_groups(entities, closure(parents)).select("key", "groups")
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    key = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c).cast("string"))
    people = customer.withColumn("key", key("customer", "c_custkey")).join(grouped, "key").select("c_custkey", "c_mktsegment", _subject(F.col("key"), "customer", F.col("groups"), [("segment", text_value(F.col("c_mktsegment"))), ("balance", int_value(F.floor("c_acctbal")))]).alias("principal"))
    things = part.withColumn("key", key("part", "p_partkey")).join(grouped, "key").select("p_partkey", "p_brand", _subject(F.col("key"), "part", F.col("groups"), [("size", int_value(F.col("p_size")))]).alias("resource"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(people, F.col("o_custkey") == F.col("c_custkey")).join(things, F.col("l_partkey") == F.col("p_partkey"))
    action = F.when(F.col("l_returnflag") == "R", "return").when(F.col("l_returnflag") == "A", "audit").otherwise("view")
    context = F.create_map(F.lit("quantity"), int_value(F.col("l_quantity").cast("bigint")), F.lit("status"), text_value(F.col("l_linestatus")))
    return rows.select(F.lit("sales").alias("policy_id"), "l_orderkey", "l_linenumber", "c_mktsegment", "p_brand", action.alias("action"), "principal", "resource", context.alias("context"))


#: The stand-in policy, spelled out.
SALES_SQL = """req AS (
  SELECT l_orderkey, l_linenumber, c_custkey, p_partkey, c_mktsegment, p_brand, substr(p_brand, 1, 7) AS brand, p_size, n_nationkey, r_name, CAST(floor(c_acctbal) AS BIGINT) AS balance,
         CAST(l_quantity AS BIGINT) AS quantity, l_linestatus AS status, CASE l_returnflag WHEN 'R' THEN 'return' WHEN 'A' THEN 'audit' ELSE 'view' END AS action
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
scoped AS (
  SELECT *,
    action IN ('view', 'return') AND r_name = 'EUROPE' AS s1, action = 'view' AND brand = 'Brand#1' AS s2, action = 'return' AS s3,
    r_name = 'ASIA' AS s4, action IN ('audit', 'view') AND n_nationkey = 3 AS s5, action = 'audit' AS s6, c_custkey = 7 AS s7
  FROM req),
hit AS (
  SELECT *, s1 AS m1, s2 AND quantity < 30 AS m2, s3 AND p_size >= 40 AS m3, s4 AND c_mktsegment = 'BUILDING' AS m4, s5 AND status != 'F' AS m5,
         s6 AND balance > p_size AND quantity >= 10 AS m6, s7 AS m7
  FROM scoped),
dec AS (
  SELECT *, CASE WHEN (m1 OR m2 OR m4 OR m6 OR m7) AND NOT (m3 OR m5) THEN 'allow' ELSE 'deny' END AS decision,
         CASE WHEN m3 OR m5 THEN 'forbid' WHEN m1 OR m2 OR m4 OR m6 OR m7 THEN 'permit' WHEN s1 OR s2 OR s4 OR s6 OR s7 THEN 'condition' ELSE 'scope' END AS governing
  FROM hit)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.policy import evaluate

    return evaluate(sales_requests(spark, sf_dir), sales_rules(spark))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as tool calls: episode, turn, role, tool, allowed, label, rendering."""
    return turns_of(table(spark, sf_dir, "conversations"))


def turns_of(own: DataFrame) -> DataFrame:
    size = F.length(F.coalesce("text", F.lit("")))
    tool = F.when(F.col("role") != "assistant", F.lit(None)).when(size % 4 == 0, "respond").when(size % 4 == 1, "execute").when(size % 4 == 2, "lookup").otherwise("invalid")
    conv = F.col("conv_id")
    return own.select(
        conv.alias("episode"), "turn", "role", tool.alias("tool"), (size % 3 != 0).alias("allowed"), F.when(conv % 2 == 0, "allow").otherwise("deny").alias("label"),
        F.element_at(F.array(*map(F.lit, RENDERINGS)), (conv % 6 + 1).cast("int")).alias("rendering"), F.concat(F.lit("w"), (conv % 7).cast("string")).alias("world_id"), size.alias("size"),
    )


TURNS_SQL = f"""turns AS (
  SELECT conv_id AS episode, turn, role, length(coalesce(text, '')) AS size,
    CASE WHEN role != 'assistant' THEN NULL WHEN length(coalesce(text, '')) % 4 = 0 THEN 'respond' WHEN length(coalesce(text, '')) % 4 = 1 THEN 'execute'
         WHEN length(coalesce(text, '')) % 4 = 2 THEN 'lookup' ELSE 'invalid' END AS tool,
    length(coalesce(text, '')) % 3 != 0 AS allowed, CASE WHEN conv_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS label,
    {list(RENDERINGS)}[CAST(conv_id % 6 + 1 AS INTEGER)] AS rendering, 'w' || CAST(conv_id % 7 AS VARCHAR) AS world_id
  FROM conversations)"""
