"""Queries over access policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy_text as PT
from ..operators import policy as P
from ..schemas import CONDITION, RULE, SCOPE, bool_value, int_value, text_value
from . import fixtures as X


def policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.decided(spark, sf_dir).groupBy("c_mktsegment", "action", "decision").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("permits")).alias("permits"), F.sum(F.size("forbids")).alias("forbids"))


def policy_governing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.decided(spark, sf_dir).groupBy("action", "governing").agg(F.count(F.lit(1)).alias("n"))


def policy_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.owner_sets(X.decided(spark, sf_dir), ["p_brand", "action"])


def membership_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parents = X.sales_entities(spark, sf_dir)
    return P.closure(parents).groupBy("ancestor").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("first_member"))


def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales policy, with a cycle through the nations of one region, orphans and clashing attributes put in."""
    entities, parents = X.sales_entities(spark, sf_dir)
    region = X.table(spark, sf_dir, "region").select(F.lit("sales").alias("policy_id"), F.concat(F.lit("region::"), "r_name").alias("key"), F.lit("nation::3").alias("parent"))
    supplier = X.table(spark, sf_dir, "supplier").select(F.lit("sales").alias("policy_id"), F.concat(F.lit("customer::"), F.col("s_suppkey").cast("string")).alias("key"), F.concat(F.lit("depot::"), (F.col("s_nationkey") % 3).cast("string")).alias("parent"))
    customer = X.table(spark, sf_dir, "customer")
    attrs = customer.select(F.lit("sales").alias("policy_id"), F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("key"), F.lit("customer").alias("type"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("balance").alias("attr"), F.lit("int").alias("value_type"))
    found = P.violations(entities, parents.unionAll(region.where("key = 'region::ASIA'")).unionAll(supplier), attrs, X.sales_rules(spark))
    return found.select("kind", "item").distinct()


def policy_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per customer nation: rules are its segments, with a condition where balances are owed."""
    customer = X.table(spark, sf_dir, "customer")
    each = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("least"))
    rules = each.select(F.col("c_nationkey").cast("string").alias("policy_id"), F.struct(F.col("c_mktsegment").alias("rule_id"), F.when(F.col("least") < -900, F.array(F.lit("owed"))).otherwise(F.array().cast("array<string>")).alias("conditions")).alias("rule"))
    return P.tier(rules).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed universe for each segment: nations x quantities x sizes, decided by thresholds that vary with the segment."""
    customer = X.table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    sizes = X.table(spark, sf_dir, "part").select("p_size").distinct()
    quantities = X.table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("bigint") % 10).alias("quantity")).distinct()
    every = customer.select("c_mktsegment", "c_nationkey").join(F.broadcast(sizes)).join(F.broadcast(quantities))  # at most 50 sizes and 10 quantities
    allow = (F.col("quantity") * 5 + F.col("p_size") + F.length("c_mktsegment") * 3 > 60) & (F.col("c_nationkey") % 5 != 0)
    return every.withColumn("decision", F.when(allow, "allow").otherwise("deny"))


_GRID = """grid AS (
  SELECT *, CASE WHEN quantity * 5 + p_size + length(c_mktsegment) * 3 > 60 AND c_nationkey % 5 != 0 THEN 'allow' ELSE 'deny' END AS decision
  FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), (SELECT DISTINCT p_size FROM part), (SELECT DISTINCT CAST(l_quantity AS BIGINT) % 10 AS quantity FROM lineitem)),
bound AS (
  SELECT *, min(decision) OVER (PARTITION BY c_mktsegment, p_size, quantity) != max(decision) OVER (PARTITION BY c_mktsegment, p_size, quantity)
         OR min(decision) OVER (PARTITION BY c_mktsegment, c_nationkey, quantity) != max(decision) OVER (PARTITION BY c_mktsegment, c_nationkey, quantity)
         OR min(decision) OVER (PARTITION BY c_mktsegment, c_nationkey, p_size) != max(decision) OVER (PARTITION BY c_mktsegment, c_nationkey, p_size) AS boundary
  FROM grid)"""


def universe_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.boundary(_grid(spark, sf_dir), ["c_mktsegment"], ["c_nationkey", "p_size", "quantity"])
    return found.groupBy("c_mktsegment", "decision", "boundary").agg(F.count(F.lit(1)).alias("n"))


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.boundary(_grid(spark, sf_dir), ["c_mktsegment"], ["c_nationkey", "p_size", "quantity"])
    order = F.md5(F.concat_ws("|", F.lit("7"), "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("p_size").cast("string"), F.col("quantity").cast("string")))
    return P.balanced_sample(found, ["c_mktsegment"], "decision", "boundary", order, 12).select("c_mktsegment", "decision", "boundary", "c_nationkey", "p_size", "quantity", "rank")


def non_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with enough requests of either decision, enough of them on the boundary, and more than one principal."""
    found = P.boundary(_grid(spark, sf_dir), ["c_mktsegment"], ["c_nationkey", "p_size", "quantity"])
    each = found.groupBy("c_mktsegment").agg(F.count_if(F.col("decision") == "allow").alias("allows"), F.count_if(F.col("decision") == "deny").alias("denies"), F.count_if("boundary").alias("on_boundary"), F.count_distinct("c_nationkey").alias("principals"))
    return each.withColumn("kept", (F.least("allows", "denies") >= 8) & (F.col("on_boundary") >= 4) & (F.col("principals") >= 2))


def name_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = X.table(spark, sf_dir, "customer").select("c_nationkey", "c_name")
    return P.rotation(customer, ["c_nationkey"], "c_name")


def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 25 documents of each source, in order of a hash of their text."""
    docs = X.table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("digest"))
    return P.first_per_key(docs, ["source"], ["digest", "doc_id"], 25).select("source", "doc_id")


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text within its source: a minimum with map-side combining, as copies may be many."""
    docs = X.table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def context_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals that part sizes and line flags are compared with, as condition values of a policy for each brand."""
    part = X.table(spark, sf_dir, "part")
    literal = F.struct(F.when(F.col("p_size") % 10 == 0, F.col("p_size").cast("bigint")).alias("i"), F.lit(None).cast("string").alias("s"))
    sizes = part.select(F.col("p_brand").alias("policy_id"), F.lit("size").alias("key"), literal.alias("literal"))
    kinds = part.select(F.col("p_brand").alias("policy_id"), F.lit("kind").alias("key"), F.struct(F.lit(None).cast("bigint").alias("i"), F.when(F.col("p_size") < 5, F.substring_index("p_type", " ", 1)).alias("s")).alias("literal"))
    brands = part.select(F.col("p_brand").alias("policy_id")).distinct()
    keys = brands.select("policy_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(t).alias("kind")) for k, t in (("size", "int"), ("kind", "str"), ("new", "bool"))))).alias("k")).select("policy_id", "k.key", "k.kind")
    return P.context_values(sizes.unionAll(kinds), keys).select("policy_id", "key", F.array_join("options", ",").alias("options"))


def renamed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under the rotation of names: regions and nations swap names in rules, and requests keep theirs."""
    nation, region = X.table(spark, sf_dir, "nation"), X.table(spark, sf_dir, "region")
    names = P.rotation(region.select(F.lit("region").alias("type"), F.col("r_name").alias("id")), ["type"], "id").unionAll(P.rotation(nation.select(F.lit("nation").alias("type"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id")), ["type"], "id").select("type", F.col("id").cast("int").cast("string"), F.col("renamed").cast("int").cast("string")))
    rules = P.rename_rules(X.sales_rules(spark), names.withColumn("policy_id", F.lit("sales")))
    return P.evaluate(X.sales_requests(spark, sf_dir), rules).groupBy("action", "decision").agg(F.count(F.lit(1)).alias("n"))


def decisive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the number of requests that each decides alone; dead rules have none."""
    rules = X.sales_rules(spark).select("policy_id", F.col("rule.rule_id").alias("rule_id"))
    found = P.decisive_rules(X.decided(spark, sf_dir))
    return rules.join(found, ["policy_id", "rule_id"], "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))


def rule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.conflicts(X.decided(spark, sf_dir)).select("permit", "forbid", "n")


def drawn_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random policy for each customer segment and nation, over a closed universe of its regions' groups and the part sizes: how many pass the bar, and why not."""
    from ..operators import generate as G

    ids = X.table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("policy_id")).distinct()
    regions = [r[0] for r in X.table(spark, sf_dir, "region").select("r_name").distinct().orderBy("r_name").collect()]  # five: the dimension's keys
    rules = G.draw_rules(ids, regions, ["audit", "return", "view"], "nation", "part", "size", 50, seed=5)
    nations = X.table(spark, sf_dir, "nation").join(X.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.concat(F.lit("nation::"), F.col("n_nationkey").cast("string"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<t:string,s:string,i:bigint,b:boolean>>"))
    who = nations.select(F.struct(key.alias("key"), F.lit("nation").alias("type"), F.array(key, F.concat(F.lit("group::"), "r_name")).alias("groups"), none.alias("attrs")).alias("principal"))
    sizes = X.table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("s")).distinct()
    what = sizes.select(F.struct(F.concat(F.lit("part::"), F.col("s").cast("string")).alias("key"), F.lit("part").alias("type"), F.array(F.lit("part")).alias("groups"), F.create_map(F.lit("size"), F.struct(F.lit("int").alias("t"), F.lit(None).cast("string").alias("s"), F.col("s").alias("i"), F.lit(None).cast("boolean").alias("b"))).alias("attrs")).alias("resource"))
    acts = ids.select("policy_id", F.explode(F.array(*map(F.lit, ("audit", "return", "view")))).alias("action"))
    requests = P.universe(ids.join(F.broadcast(who)), acts, ids.join(F.broadcast(what)), ids.withColumn("context", none))  # 25 nations and 50 sizes
    decided = P.evaluate(requests, rules).withColumn("who", F.col("principal.key")).withColumn("what", F.col("resource.key"))
    marked = P.boundary(decided, ["policy_id"], ["who", "action", "what"])
    return G.keep_reason(marked, rules, 4).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _supplier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of up to 20 rules, one a supplier, with every kind of scope, of operand and of value."""
    s = X.table(spark, sf_dir, "supplier")
    k, nation, name = F.col("s_suppkey"), F.col("s_nationkey").cast("string"), F.col("s_name")
    no = F.lit(None)
    entity = lambda kind, id_: F.struct(F.lit(kind).alias("type"), id_.alias("id"))
    scope = lambda kind, of=no, typed=no: F.struct(F.lit(kind).alias("kind"), of.alias("entity"), typed.alias("type")).cast(SCOPE)
    pick = lambda n, *options: F.element_at(F.array(*options), (n + 1).cast("int"))
    principal = pick(k % 5, scope("any"), scope("eq", entity("supplier", name)), scope("is", typed=F.lit("customer")), scope("in", entity("nation", nation)), scope("is_in", entity("nation", nation), F.lit("customer")))
    resource = pick(F.floor(k / 5) % 3, scope("any"), scope("is", typed=F.lit("part")), scope("in", entity("brand", F.concat(F.lit("Brand #"), (k % 9).cast("string")))))
    attr = lambda subject, a: F.struct(F.lit(subject).alias("subject"), F.lit(a).alias("attr"), no.alias("value"))
    value = lambda v: F.struct(no.alias("subject"), no.alias("attr"), v.alias("value"))
    test = lambda a, op, b: F.struct(a.alias("left"), F.lit(op).alias("op"), b.alias("right")).cast(CONDITION)
    owed, named, flag, sized = test(attr("context", "balance"), ">=", value(int_value(F.floor("s_acctbal")))), test(attr("principal", "name"), "!=", value(text_value(name))), test(attr("context", "mfa"), "==", value(bool_value(F.lit(True)))), test(attr("resource", "size"), "<", attr("principal", "level"))
    conditions = pick(k % 4, F.array().cast(f"array<{CONDITION}>"), F.array(owed), F.array(named, flag), F.array(sized))
    actions = F.when(k % 2 == 0, F.array(F.lit("view"))).otherwise(F.array(F.lit("audit"), F.lit("view")))
    rule = F.struct(F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), F.when(k % 3 == 0, "forbid").otherwise("permit").alias("effect"), principal.alias("principal"), actions.alias("actions"), resource.alias("resource"), conditions.alias("conditions")).cast(RULE)
    return s.select("s_nationkey", F.floor(k / 20).alias("part"), rule.alias("rule")).groupBy("s_nationkey", "part").agg(F.collect_list("rule").alias("rules"))


def whole_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' rules as whole policies in five forms: how many read back, and digests of prose, rows and code."""
    rules = F.col("rules")
    want = F.array_sort(rules, lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0))
    mark = lambda c: F.sum(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"))
    texts = _supplier_rules(spark, sf_dir).select("s_nationkey", want.alias("want"), PT.prose(rules).alias("prose"), PT.table(rules).alias("rows"), PT.duties(rules).alias("duties"), PT.as_json(rules).alias("json"), PT.code(rules).alias("code"))
    same = lambda c: F.count_if(c == F.col("want"))
    return texts.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("policies"), F.sum(F.size("want")).alias("rules"), same(PT.read_prose(F.col("prose"))).alias("prose_back"), same(PT.read_table(F.col("rows"))).alias("rows_back"),
        same(PT.read_duties(F.col("duties"))).alias("duties_back"), same(PT.read_json(F.col("json"))).alias("json_back"), mark("prose").alias("prose"), mark("rows").alias("rows"), mark("duties").alias("duties"), mark("code").alias("code"),
    )


def _renamed_sql() -> str:
    sql = X.SALES_SQL
    for old, new in (("r_name = 'EUROPE'", "r_name = (SELECT n FROM nr WHERE o = 'EUROPE')"), ("r_name = 'ASIA'", "r_name = (SELECT n FROM nr WHERE o = 'ASIA')"), ("n_nationkey = 3", "n_nationkey = (SELECT coalesce(min(n_nationkey), (SELECT min(n_nationkey) FROM nation)) FROM nation WHERE n_nationkey > 3)")):
        assert old in sql
        sql = sql.replace(old, new)
    return "nr AS (SELECT r_name AS o, coalesce(lead(r_name) OVER (ORDER BY r_name), (SELECT min(r_name) FROM region)) AS n FROM region), " + sql


SQL = {
    "drawn_policies": """WITH g AS (SELECT list(r_name ORDER BY r_name) AS names FROM (SELECT DISTINCT r_name FROM region)),
ids AS (SELECT DISTINCT c_mktsegment || '/' || c_nationkey AS p FROM customer),
e AS (SELECT p, unnest(range(0, ('0x' || substr(md5('5|' || p || '|n'), 1, 12))::BIGINT % 3 + 1)) AS k FROM ids),
d AS (SELECT p, k, list_transform(['group', 'who', 'a', 'b', 'effect', 'threshold', 'op', 'when'], lambda w: ('0x' || substr(md5('5|' || p || '|' || k || '|' || w), 1, 12))::BIGINT) AS h FROM e),
r AS (SELECT p, k, names[CAST(h[1] % len(names) + 1 AS INTEGER)] AS grp, h[2] % 3 = 0 AS every, ['audit', 'return', 'view'][CAST(h[3] % 3 + 1 AS INTEGER)] AS a, ['audit', 'return', 'view'][CAST(h[4] % 3 + 1 AS INTEGER)] AS b, h[5] % 3 = 0 AS forbid, h[6] % 50 AS t, h[7] % 2 = 0 AS below, h[8] % 2 = 1 AS cond FROM d, g),
u AS (SELECT p, n_nationkey AS who, r_name, action, s AS what FROM ids, nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('audit'), ('return'), ('view')) v(action), (SELECT DISTINCT p_size AS s FROM part)),
m AS (SELECT u.p, who, action, what, list(k) FILTER (NOT forbid) AS permits, list(k) FILTER (forbid) AS forbids FROM u LEFT JOIN r ON u.p = r.p AND action IN (a, b) AND (every OR grp = r_name) AND (NOT cond OR CASE WHEN below THEN what < t ELSE what >= t END) GROUP BY ALL),
c AS (SELECT *, permits IS NOT NULL AND forbids IS NULL AS ok, CASE WHEN forbids IS NULL AND len(permits) = 1 THEN permits[1] WHEN permits IS NOT NULL AND len(forbids) = 1 THEN forbids[1] END AS sole FROM m),
b AS (SELECT *, min(ok) OVER x != max(ok) OVER x OR min(ok) OVER y != max(ok) OVER y OR min(ok) OVER z != max(ok) OVER z AS edge FROM c WINDOW x AS (PARTITION BY p, action, what), y AS (PARTITION BY p, who, what), z AS (PARTITION BY p, who, action)),
s AS (SELECT p, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS d, count(*) FILTER (ok AND edge) AS ae, count(*) FILTER (NOT ok AND edge) AS de, count(DISTINCT sole) AS live FROM b GROUP BY p),
n AS (SELECT p, count(*) AS rules FROM e GROUP BY p)
SELECT CASE WHEN a < 4 THEN 'too few allowed' WHEN d < 4 THEN 'too few denied' WHEN ae < 2 OR de < 2 THEN 'too few on the boundary' WHEN rules > 1 AND live < rules THEN 'dead rule' ELSE 'ok' END AS reason, count(*) AS n FROM s JOIN n USING (p) GROUP BY ALL""",
    "whole_policies": r"""WITH k AS (SELECT s_nationkey, s_suppkey // 20 AS part, s_suppkey AS i, 'r' || s_suppkey AS id, 'nation::"' || s_nationkey || '"' AS n, 'supplier::"' || url_encode(s_name) || '"' AS s, '"' || url_encode(s_name) || '"' AS q, 'brand::"Brand+%23' || s_suppkey % 9 || '"' AS b, CAST(floor(s_acctbal) AS BIGINT) AS bal, s_suppkey % 3 = 0 AS forbid, s_suppkey % 2 = 0 AS one FROM supplier),
t AS (SELECT *, ['anything', 'exactly ' || s, 'any customer', 'members of ' || n, 'any customer in ' || n][CAST(i % 5 + 1 AS INTEGER)] AS who, ['anything', 'any part', 'members of ' || b][CAST(i // 5 % 3 + 1 AS INTEGER)] AS what,
  ['', ' == ' || s, ' is customer', ' in ' || n, ' is customer in ' || n][CAST(i % 5 + 1 AS INTEGER)] AS who_c, ['', ' is part', ' in ' || b][CAST(i // 5 % 3 + 1 AS INTEGER)] AS what_c,
  [NULL, 'context.balance is at least ' || bal, 'principal.name is not ' || q || ' and context.mfa is true', 'resource.size is below principal.level'][CAST(i % 4 + 1 AS INTEGER)] AS words,
  [NULL, 'context.balance >= ' || bal, 'principal.name != ' || q || ' {} context.mfa == true', 'resource.size < principal.level'][CAST(i % 4 + 1 AS INTEGER)] AS signs FROM k),
l AS (SELECT s_nationkey, part, id, 'Rule ' || id || ': ' || who || CASE WHEN forbid THEN ' must not ' ELSE ' may ' END || CASE WHEN one THEN 'view' ELSE 'audit or view' END || ' ' || what || coalesce(' when ' || words, '') || '.' AS prose,
  '| ' || id || CASE WHEN forbid THEN ' | forbid | ' ELSE ' | permit | ' END || who || CASE WHEN one THEN ' | view | ' ELSE ' | audit, view | ' END || what || ' | ' || coalesce(replace(signs, '{}', '&') || ' |', '|') AS row_,
  list_transform(CASE WHEN one THEN ['view'] ELSE ['audit', 'view'] END, lambda a: what || CASE WHEN forbid THEN ' bars ' ELSE ' lets ' END || who || ' [' || a || '] by ' || id || coalesce(' where ' || words, '')) AS duties,
  '@id("' || id || '") ' || CASE WHEN forbid THEN 'forbid' ELSE 'permit' END || ' (principal' || who_c || ', action in [' || CASE WHEN one THEN 'Action::"view"' ELSE 'Action::"audit", Action::"view"' END || '], resource' || what_c || ')' || coalesce(' when { ' || replace(signs, '{}', '&&') || ' }', '') || ';' AS code FROM t),
p AS (SELECT s_nationkey, part, count(*) AS n, string_agg(prose, chr(10) ORDER BY id) AS prose, string_agg(row_, chr(10) ORDER BY id) AS rows_, string_agg(array_to_string(duties, chr(10)), chr(10) ORDER BY id) AS duties, string_agg(code, chr(10) ORDER BY id) AS code FROM l GROUP BY ALL)
SELECT s_nationkey, count(*) AS policies, CAST(sum(n) AS BIGINT) AS rules, count(*) AS prose_back, count(*) AS rows_back, count(*) AS duties_back, count(*) AS json_back, CAST(sum(('0x' || substr(md5(prose), 1, 8))::BIGINT) AS BIGINT) AS prose,
  CAST(sum(('0x' || substr(md5(rows_), 1, 8))::BIGINT) AS BIGINT) AS rows, CAST(sum(('0x' || substr(md5(duties), 1, 8))::BIGINT) AS BIGINT) AS duties, CAST(sum(('0x' || substr(md5(code), 1, 8))::BIGINT) AS BIGINT) AS code FROM p GROUP BY s_nationkey""",
    "policy_decide": f"""WITH {X.SALES_SQL}
SELECT c_mktsegment, action, decision, count(*) AS n, CAST(sum(m1::INT + m2::INT + m4::INT + m6::INT + m7::INT) AS BIGINT) AS permits, CAST(sum(m3::INT + m5::INT) AS BIGINT) AS forbids
FROM dec GROUP BY ALL""",
    "policy_governing": f"WITH {X.SALES_SQL} SELECT action, governing, count(*) AS n FROM dec GROUP BY ALL",
    "policy_owners": f"""WITH {X.SALES_SQL}
SELECT p_brand, action, count(k) AS n_owners, CAST(coalesce(sum(('0x' || substr(md5(k), 1, 8))::BIGINT), 0) AS BIGINT) AS digest
FROM (SELECT DISTINCT p_brand, action, CASE WHEN decision = 'allow' THEN 'customer::' || CAST(c_custkey AS VARCHAR) END AS k FROM dec) GROUP BY p_brand, action""",
    "membership_closure": """WITH RECURSIVE p AS (
  SELECT 'customer::' || c_custkey AS key, 'nation::' || c_nationkey AS parent FROM customer
  UNION SELECT 'nation::' || n_nationkey, 'region::' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'part::' || p_partkey, 'brand::' || substr(p_brand, 1, 7) FROM part),
c AS (SELECT key, parent AS ancestor FROM p UNION SELECT c.key, p.parent FROM c JOIN p ON c.ancestor = p.key)
SELECT ancestor, count(*) AS members, min(key) AS first_member FROM c GROUP BY ancestor""",
    "policy_violations": """WITH RECURSIVE e AS (
  SELECT 'customer::' || c_custkey AS key, 'customer' AS type FROM customer UNION ALL SELECT 'nation::' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'region::' || r_name, 'region' FROM region UNION ALL SELECT 'part::' || p_partkey, 'part' FROM part
  UNION ALL SELECT DISTINCT 'brand::' || substr(p_brand, 1, 7), 'brand' FROM part),
p AS (
  SELECT 'customer::' || c_custkey AS key, 'nation::' || c_nationkey AS parent FROM customer
  UNION SELECT 'nation::' || n_nationkey, 'region::' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'part::' || p_partkey, 'brand::' || substr(p_brand, 1, 7) FROM part
  UNION SELECT 'region::ASIA', 'nation::3' FROM region WHERE r_name = 'ASIA'
  UNION SELECT 'customer::' || s_suppkey, 'depot::' || (s_nationkey % 3) FROM supplier),
c AS (SELECT key, parent AS ancestor FROM p UNION SELECT c.key, p.parent FROM c JOIN p ON c.ancestor = p.key),
shape AS (SELECT e.type, CASE WHEN c_custkey IS NULL THEN '' WHEN c_acctbal < 0 THEN 'debt' ELSE 'balance' END AS s FROM e LEFT JOIN customer ON e.key = 'customer::' || c_custkey)
SELECT 'unknown parent' AS kind, parent AS item FROM p WHERE parent NOT IN (SELECT key FROM e)
UNION SELECT 'cyclic membership', key FROM c WHERE key = ancestor
UNION SELECT 'mixed attributes', type FROM shape GROUP BY type HAVING count(DISTINCT s) > 1
UNION SELECT 'repeated entity', key FROM e GROUP BY key HAVING count(*) > 1
UNION SELECT 'unknown scope target', t FROM (VALUES ('region::EUROPE'), ('brand::Brand#1'), ('region::ASIA'), ('nation::3'), ('customer::7')) v(t) WHERE t NOT IN (SELECT key FROM e)""",
    "policy_tiers": """WITH r AS (SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS least FROM customer GROUP BY ALL)
SELECT tier, count(*) AS n FROM (SELECT c_nationkey, CASE WHEN min(least) < -900 THEN 'conditioned' WHEN count(*) > 1 THEN 'multi_rule' ELSE 'single' END AS tier FROM r GROUP BY c_nationkey) GROUP BY tier""",
    "universe_boundary": f"WITH {_GRID} SELECT c_mktsegment, decision, boundary, count(*) AS n FROM bound GROUP BY ALL",
    "balanced_sample": f"""WITH {_GRID}
SELECT * FROM (SELECT c_mktsegment, decision, boundary, c_nationkey, p_size, quantity, CAST(row_number() OVER (PARTITION BY c_mktsegment, decision
  ORDER BY boundary DESC, md5('7|' || c_mktsegment || '|' || c_nationkey || '|' || p_size || '|' || quantity)) AS INTEGER) AS rank FROM bound) WHERE rank <= 12""",
    "non_degenerate": f"""WITH {_GRID}, g AS (
  SELECT c_mktsegment, count(*) FILTER (decision = 'allow') AS allows, count(*) FILTER (decision = 'deny') AS denies, count(*) FILTER (boundary) AS on_boundary, count(DISTINCT c_nationkey) AS principals FROM bound GROUP BY c_mktsegment)
SELECT *, least(allows, denies) >= 8 AND on_boundary >= 4 AND principals >= 2 AS kept FROM g""",
    "name_rotation": """WITH k AS (SELECT DISTINCT c_nationkey, c_name FROM customer)
SELECT c_nationkey, c_name, coalesce(lead(c_name) OVER w, first_value(c_name) OVER w) AS renamed FROM k WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_name)""",
    "cap_per_group": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(text), doc_id) AS r FROM documents) WHERE r <= 25",
    "dedup_keep_first": "SELECT source, md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY source, md5(text)",
    "context_values": """WITH b AS (SELECT DISTINCT p_brand AS policy_id FROM part),
i AS (SELECT DISTINCT p_brand AS policy_id, unnest([p_size - 1, p_size, p_size + 1]) AS x FROM part WHERE p_size % 10 = 0),
s AS (SELECT DISTINCT p_brand AS policy_id, split_part(p_type, ' ', 1) AS x FROM part WHERE p_size < 5)
SELECT policy_id, 'size' AS key, coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM i WHERE i.policy_id = b.policy_id), '0') AS options FROM b
UNION ALL SELECT policy_id, 'kind', coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM s WHERE s.policy_id = b.policy_id) || ',', '') || '~other' FROM b
UNION ALL SELECT policy_id, 'new', 'false,true' FROM b""",
    "decisive_rules": f"""WITH {X.SALES_SQL},
k AS (SELECT *, m1::INT + m2::INT + m4::INT + m6::INT + m7::INT AS p, m3::INT + m5::INT AS f FROM dec)
SELECT rule_id, count(*) FILTER (CASE rule_id WHEN 'r1' THEN m1 AND p = 1 AND f = 0 WHEN 'r2' THEN m2 AND p = 1 AND f = 0 WHEN 'r4' THEN m4 AND p = 1 AND f = 0 WHEN 'r6' THEN m6 AND p = 1 AND f = 0
  WHEN 'r7' THEN m7 AND p = 1 AND f = 0 WHEN 'r3' THEN m3 AND f = 1 AND p > 0 ELSE m5 AND f = 1 AND p > 0 END) AS n FROM k, (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), ('r6'), ('r7')) v(rule_id) GROUP BY rule_id""",
    "rule_conflicts": f"""WITH {X.SALES_SQL}, p AS (
  SELECT a.permit, b.forbid FROM dec, LATERAL (SELECT unnest(list_filter([CASE WHEN m1 THEN 'r1' END, CASE WHEN m2 THEN 'r2' END, CASE WHEN m4 THEN 'r4' END, CASE WHEN m6 THEN 'r6' END, CASE WHEN m7 THEN 'r7' END], lambda x: x IS NOT NULL)) AS permit) a,
    LATERAL (SELECT unnest(list_filter([CASE WHEN m3 THEN 'r3' END, CASE WHEN m5 THEN 'r5' END], lambda x: x IS NOT NULL)) AS forbid) b)
SELECT permit, forbid, count(*) AS n FROM p GROUP BY ALL""",
    "renamed_rules": f"WITH {_renamed_sql()} SELECT action, decision, count(*) AS n FROM dec GROUP BY ALL",
}

QUERIES = {f.__name__: f for f in (policy_decide, policy_governing, policy_owners, membership_closure, policy_violations, policy_tiers, universe_boundary, balanced_sample, non_degenerate, name_rotation, cap_per_group, dedup_keep_first, context_values, renamed_rules, decisive_rules, rule_conflicts, drawn_policies, whole_policies)}
