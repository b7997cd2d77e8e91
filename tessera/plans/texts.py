"""Queries over answer texts, rules as text, JSON access documents, and overlap of corpora."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import access_import as AI
from ..operators import iam as I
from ..operators import vectors as V
from ..schemas import bool_value, int_value, text_value
from ..sources.storage import by_merge
from . import fixtures as Fx

#: Characters that a prefix of each source should reach.
BUDGET = 20_000


def _size() -> Column:
    return F.length(F.coalesce("text", F.lit("")))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns dressed as short answers of all kinds; label is what would be right."""
    own = Fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    kind = _size() % 8
    answer = (
        F.when(kind == 0, '"allow"').when(kind == 1, "**deny**.").when(kind == 2, " I can’t help with that. ").when(kind == 3, "<think>so</think>\nallow.")
        .when(kind == 4, F.concat(F.lit("It is unclear: "), "text")).when(kind == 5, "“deny”").when(kind == 6, "The answer is allow").otherwise(F.col("text"))
    )
    return own.select("conv_id", "turn", "text", answer.alias("answer"), F.when(_size() % 3 == 0, "allow").otherwise("deny").alias("label"))


_ANSWERS = """a AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'allow' ELSE 'deny' END AS label,
    CASE length(coalesce(text, '')) % 8 WHEN 0 THEN '"allow"' WHEN 1 THEN '**deny**.' WHEN 2 THEN ' I can’t help with that. ' WHEN 3 THEN '<think>so</think>' || chr(10) || 'allow.'
      WHEN 4 THEN 'It is unclear: ' || coalesce(text, '') WHEN 5 THEN '“deny”' WHEN 6 THEN 'The answer is allow' ELSE coalesce(text, '') END AS answer
  FROM conversations),
t AS (SELECT *, regexp_replace(regexp_replace(answer, '^\\s*<think>.*?</think>\\s*', '', 's'), '^\\s+|\\s+$', '', 'g') AS s0 FROM a),
p AS (SELECT *, CASE WHEN s0 LIKE '%.' AND s0 NOT LIKE '%..' THEN regexp_replace(s0[:-2], '\\s+$', '') ELSE s0 END AS s1 FROM t),
q AS (SELECT *, CASE WHEN length(s1) > 4 AND s1 LIKE '**%' AND s1 LIKE '%**' THEN s1[3:-3] WHEN length(s1) > 2 AND s1 LIKE '"%"' THEN s1[2:-2] WHEN length(s1) > 2 AND s1 LIKE '“%”' AND {v2} THEN s1[2:-2] ELSE s1 END AS s2 FROM p),
n AS (SELECT *, {fold} AS f FROM (SELECT *, CASE WHEN s2 LIKE '%.' AND s2 NOT LIKE '%..' THEN regexp_replace(s2[:-2], '\\s+$', '') ELSE s2 END AS s FROM q)),
c AS (SELECT *, CASE WHEN s IN ('allow', 'deny') THEN CASE WHEN s = label THEN 'correct' ELSE 'incorrect' END WHEN regexp_matches(f, '(?i)""" + X.REFUSAL.replace("'", "''") + """') THEN 'refusal' WHEN regexp_matches(f, '(?i)""" + X.ABSTAIN.replace("'", "''") + """') THEN 'abstain' ELSE 'parse_failure' END AS category FROM n)"""
_FOLD = "translate(s, '’‘ʼ“”', '''''''\"\"')"


def _short(version: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = _answers(spark, sf_dir).withColumn("r", X.short_answer(F.col("answer"), F.array(F.lit("allow"), F.lit("deny")), F.col("label"), version))
        return read.groupBy(F.col("r.category").alias("category"), F.col("r.selected").alias("selected")).agg(F.count(F.lit(1)).alias("n"))

    query.__name__ = f"parse_short_answer_v{version}"
    return query


def lenient_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _answers(spark, sf_dir).withColumn("r", X.short_answer(F.col("answer"), F.array(F.lit("allow"), F.lit("deny")), F.col("label")))
    return read.groupBy(F.col("r.category").alias("category"), F.col("r.lenient").alias("lenient")).agg(F.count(F.lit(1)).alias("n"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns dressed as JSON answers: bare, fenced, with a period, with trailing text, with extra or repeated keys."""
    own = Fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    d = F.when(F.col("turn") % 2 == 0, "allow").otherwise("deny")
    bare = F.concat(F.lit('{"decision": "'), d, F.lit('"}'))
    kind = _size() % 7
    answer = (
        F.when(kind == 0, bare).when(kind == 1, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).when(kind == 2, F.concat(bare, F.lit("."))).when(kind == 3, F.concat(bare, F.lit(" as said")))
        .when(kind == 4, F.concat(F.lit('{"decision": "deny", "decision": "'), d, F.lit('"}'))).when(kind == 5, F.concat(F.lit('{"decision": "'), d, F.lit('", "why": 1}'))).otherwise(F.concat(F.lit("pondering</think>"), bare))
    )
    return own.select("conv_id", "turn", answer.alias("answer"), F.when(_size() % 3 == 0, "allow").otherwise("deny").alias("label"))


_OBJECTS = """o AS (
  SELECT length(coalesce(text, '')) % 7 AS k, CASE WHEN turn % 2 = 0 THEN 'allow' ELSE 'deny' END AS d, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'allow' ELSE 'deny' END AS label FROM conversations)"""


def parse_json_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _objects(spark, sf_dir).withColumn("r", X.structured_answer(F.col("answer"), F.lit("application"), F.col("label")))
    return read.groupBy(F.col("r.category").alias("category"), F.col("r.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def last_json_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _objects(spark, sf_dir).withColumn("all", F.concat("answer", F.lit(' then {"x": {"decision": "deny"}} '), F.when(F.col("turn") % 3 == 0, '{"decision": "allow"} done').otherwise("")))
    read = read.withColumn("r", X.final_answer(F.col("all"), F.lit("application"), F.col("label")))
    return read.groupBy(F.col("r.category").alias("category"), F.col("r.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def interpretation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of ids as answers: order does not matter, repeats are no answer."""
    own = Fx.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_custkey").alias("a"), F.min("c_custkey").alias("b"))
    s = lambda c: F.concat(F.lit('"u'), F.col(c).cast("string"), F.lit('"'))
    given = F.concat(F.lit('{"principals": ['), s("a"), F.lit(", "), F.when(F.col("c_nationkey") % 4 == 0, s("a")).otherwise(s("b")), F.lit("]}"))
    order = F.array_sort(F.array(F.concat(F.lit("u"), F.col("a").cast("string")), F.concat(F.lit("u"), F.col("b").cast("string"))))
    expected = F.concat(F.lit('["'), F.array_join(order, '", "'), F.lit('"]'))
    read = own.withColumn("r", X.structured_answer(given, F.lit("interpretation"), expected))
    return read.groupBy("c_mktsegment", F.col("r.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit("<|channel|>analysis<|message|> "), "text", F.lit(" <|end|><|start|>assistant"))
    raw = F.when(F.col("turn") % 3 == 0, head).otherwise(F.concat(head, F.lit("<|channel|>final<|message|> so "), F.col("turn").cast("string"), F.lit(" <|return|>")))
    read = own.withColumn("r", X.channels(raw))
    return read.groupBy(F.col("r.found").alias("found"), F.col("r.text").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("r.reasoning")).alias("thought"))


def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the canonical form of their properties, with one key put before the others out of order."""
    own = Fx.table(spark, sf_dir, "events").select("event_type", F.concat(F.lit('{"z": "é", '), F.substring("props", F.lit(2), F.length("props"))).alias("props"))
    read = own.withColumn("canonical", X.canonical_json(F.col("props")))
    return read.groupBy("event_type").agg(F.count("canonical").alias("n"), F.sum(F.when(F.col("canonical").startswith('{"k":') & F.col("canonical").endswith(',"z":"\\u00e9"}'), 1).otherwise(0)).alias("ordered"), F.count_distinct("canonical").alias("forms"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each nation and segment with customers; owed balances forbid."""
    each = Fx.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("least"), F.count(F.lit(1)).alias("n"))
    return each.select("c_mktsegment", F.when(F.col("least") < -500, "forbid").otherwise("permit").alias("effect"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("group"), F.when(F.col("n") % 2 == 0, F.array(F.lit("view"), F.lit("audit"))).otherwise(F.array(F.lit("view"))).alias("actions"), F.lower("c_mktsegment").alias("kind"))


def rendering_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as sentences and as table rows, and whether each form reads back as the rule."""
    parts = [F.col(c) for c in ("effect", "group", "actions", "kind")]
    rule = F.struct(parts[0], parts[1], F.array_sort("actions").alias("actions"), parts[3])
    own = _rules(spark, sf_dir).withColumn("rule", rule).withColumn("sentence", X.rule_sentence(*parts)).withColumn("row", X.rule_row(*parts))
    back = own.withColumn("s", X.sentence_rule(F.col("sentence"))).withColumn("t", X.row_rule(F.col("row")))
    return back.groupBy("effect").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == F.col("rule")).alias("sentences"), F.count_if(F.col("t") == F.col("rule")).alias("rows"), F.sum(F.length("sentence")).alias("sentence_chars"), F.sum(F.length("row")).alias("row_chars"))


def rendering_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as JSON, as duties and as code, whether the first two read back, and that spoilt forms do not."""
    parts = [F.col(c) for c in ("effect", "group", "actions", "kind")]
    rule = F.struct(parts[0], parts[1], F.array_sort("actions").alias("actions"), parts[3])
    own = _rules(spark, sf_dir).withColumn("rule", rule).withColumn("j", X.rule_json(*parts)).withColumn("d", X.rule_duties(*parts))
    spoilt = F.regexp_replace("d", "lets", "suffers")
    back = own.withColumn("code", X.rule_code(F.col("group"), *parts))
    return back.groupBy("effect").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.json_rule(F.col("j")) == F.col("rule")).alias("json"), F.count_if(X.duties_rule(F.col("d")) == F.col("rule")).alias("duties"), F.count(X.duties_rule(spoilt)).alias("spoilt"), F.sum(F.size(F.split("code", "\n"))).alias("code_lines"))


def rule_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule sets of nations against perturbed ones: exact by normal form, equivalent if no request of the closed universe is decided otherwise."""
    seg = Fx.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.count(F.lit(1)) % 12).alias("limit"))
    shifted = F.when((F.col("c_nationkey") % 3 == 0) & (F.length("c_mktsegment") % 2 == 0), F.col("limit") + 1).otherwise(F.col("limit"))
    rule = lambda c: F.struct(F.lit("permit").alias("effect"), F.col("c_mktsegment").alias("group"), F.array(c.cast("string")).alias("actions"), F.lit("part").alias("kind"))
    sets = seg.groupBy("c_nationkey").agg(F.collect_list(rule(F.col("limit"))).alias("gold"), F.collect_list(rule(shifted)).alias("given"))
    exact = sets.select("c_nationkey", (X.normal_form(F.col("gold")) == X.normal_form(F.col("given"))).alias("exact"))
    universe = seg.withColumn("shifted", shifted).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(9))))
    differ = universe.groupBy("c_nationkey").agg(F.count_if((F.col("q") < F.col("limit")) != (F.col("q") < F.col("shifted"))).alias("differ"), F.count(F.lit(1)).alias("requests"))
    return exact.join(differ, "c_nationkey").groupBy("exact", (F.col("differ") == 0).alias("equivalent")).agg(F.count(F.lit(1)).alias("n"), F.sum("differ").alias("differ"), F.sum("requests").alias("requests"))


#: Parts of the stand-in documents by the number n of a statement: JSON of what it says, and the same as wildcards for the SQL.
_ACTIONS = [["s3:Get*"], ["s3:*Object", "s3:List?"], ["S3:PUT*"], ["s3:GetObject"], ["*"], ["s3:?et*", "s3:Put?bject"]]
_THINGS = [["*"], ["arn:part/Brand#1*"], ["arn:part/*/7"], ["arn:part/Brand#?3/*"], ["arn:part/Brand#2*", "arn:part/Brand#4?/1*"], ["ARN:part/*"], ["arn:part/Brand#5?/*9"], ["*/1?"]]
_PEOPLE = ["", ', "Principal": "*"', ', "Principal": {"AWS": "BUILDING"}', ', "Principal": {"Service": ["AUTOMOBILE", "MACHINERY"], "AWS": "HOUSEHOLD"}', ', "NotPrincipal": {"Service": ["FURNITURE"]}']
_WHENS = [
    "", "", ', "Condition": {"NumericLessThan": {"quantity": "25"}}', ', "Condition": {"StringEquals": {"status": ["F", "X"]}}', ', "Condition": {"NumericNotEquals": {"quantity": [1, 2, 3]}, "StringNotEquals": {"status": "O"}}',
    ', "Condition": {"Bool": {"large": "TRUE"}}', ', "Condition": {"Bool": {"large": true}, "NumericGreaterThanEquals": {"quantity": 40}}',
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access document of three statements for each supplier, with what they say taken from its key."""
    own = Fx.table(spark, sf_dir, "supplier").select("s_suppkey")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))

    def statement(n: Column) -> Column:
        effect = F.when(n % 97 == 0, "Maybe").when(n % 4 == 3, "Deny").otherwise("Allow")
        action = F.concat(F.when(n % 11 == 10, '"NotAction": ').otherwise('"Action": '), pick([json.dumps(a if len(a) > 1 else a[0]) for a in _ACTIONS], n))
        thing = F.concat(F.when(n % 9 == 8, '"NotResource": ').otherwise('"Resource": '), pick([json.dumps(a if len(a) > 1 else a[0]) for a in _THINGS], n))
        return F.concat(F.lit('{"Effect": "'), effect, F.lit('", '), action, F.lit(", "), thing, pick(_PEOPLE, n), pick(_WHENS, n), F.lit("}"))

    n = F.col("s_suppkey") * 3
    body = F.concat_ws(", ", *(statement(n + j) for j in range(3)))
    return own.select(F.col("s_suppkey").alias("key"), F.concat(F.lit('{"Version": "2012-10-17", "Statement": ['), body, F.lit("]}")).alias("doc"))


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order line against the document of its supplier; every seventh line does not say whether it is large."""
    lines, orders, customer, part = (Fx.table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
    action = F.when(F.col("l_returnflag") == "R", "s3:GetObject").when(F.col("l_returnflag") == "A", "s3:PutObject").otherwise("S3:ListX")
    principal = F.struct(F.when(F.col("c_custkey") % 2 == 0, "AWS").otherwise("Service").alias("type"), F.col("c_mktsegment").alias("id"))
    context = [F.struct(F.lit("quantity").alias("k"), int_value(F.col("l_quantity")).alias("v")), F.struct(F.lit("status").alias("k"), text_value(F.col("l_linestatus")).alias("v"))]
    large = F.struct(F.lit("large").alias("k"), bool_value(F.col("l_extendedprice") > 40000).alias("v"))
    context = F.when(F.col("l_linenumber") == 7, F.array(*context)).otherwise(F.array(*context, large))
    return rows.select(F.col("l_suppkey").alias("key"), action.alias("action"), F.concat(F.lit("arn:part/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("resource"), principal.alias("principal"), F.map_from_entries(context).alias("context"))


def iam_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.statements(_documents(spark, sf_dir), "key", "doc")
    return I.decide(_access(spark, sf_dir), docs).groupBy("action", "decision", "refused").agg(F.count(F.lit(1)).alias("n"))


#: Documents that lack something, and the reason for which each is refused.
_ODD = [
    ('{"Statement": {"Effect": "Maybe", "Action": "a:*", "Resource": "*"}}', "effect"), ('{"Statement": {"Effect": "Allow", "Resource": "*"}}', "action"),
    ('{"Statement": {"Effect": "Allow", "Action": "a", "NotAction": ["b"], "Resource": "*"}}', "action"), ('{"Statement": {"Effect": "Allow", "Action": ["a", 1], "Resource": "*"}}', "action"),
    ('{"Statement": {"Effect": "Allow", "Action": "a"}}', "resource"), ('{"Statement": {"Effect": "Allow", "Action": "a", "Resource": "*", "Condition": "junk"}}', "condition"),
    ('{"Statement": {"Effect": "Allow", "Action": "a", "Resource": "*", "Condition": {"DateEquals": {"d": "1"}}}}', "condition"), ('{"Statement": {"Effect": "Allow", "Action": "a", "Resource": "*", "Condition": {"StringLike": {"d": "x*"}}}}', "condition"),
    ('{"Statement": {"Effect": "Allow", "Action": "a", "Resource": "*", "Condition": {"NumericEquals": {"d": []}}}}', "condition"), ('{"Statement": {"Effect": "Allow", "Action": "a", "Resource": "*", "Condition": {"NumericEquals": {"d": "1.5"}}}}', "condition"),
    ('{"Statement": {"Effect": "Allow", "Action": "a", "Resource": "*", "Condition": {"Bool": {"d": "yes"}}}}', "condition"), ('{"Statement": {"Effect": "Allow", "Principal": {"AWS": "u/*"}, "Action": "a", "Resource": "*"}}', "principal"),
    ('{"Statement": {"Effect": "Allow", "NotPrincipal": {"AWS": "u"}, "Action": "a", "Resource": "*"}}', "principal"), ('{"Statement": {"Effect": "Allow", "Principal": "u", "Action": "a", "Resource": "*"}}', "principal"),
    ('{"Statement": [{"Effect": "Allow", "Principal": {"AWS": "*"}, "Action": "a", "Resource": "*"}, 3]}', "statement"), ('{"Version": "1"}', "statement"), ("[", "json"),
    ('{"Statement": {"Effect": "Allow", "Action": "a", "Resource": "home/${user}"}}', "variable"), ('{"Statement": {"Effect": "Deny", "Action": "a", "Resource": "*", "Condition": {"Bool": {"d": ["true", false]}}}}', None),
    ('{"Statement": []}', None),
]


def iam_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with documents of which most lack what a statement needs, by the reason they are refused for."""
    k = F.col("c_custkey")
    doc = F.element_at(F.array(*(F.lit(d) for d, _ in _ODD)), (k % len(_ODD) + 1).cast("int"))
    docs = I.statements(Fx.table(spark, sf_dir, "customer").select(k.alias("key"), doc.alias("doc")), "key", "doc")
    return I.unsupported(docs).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_WORLD_ACTIONS, _WORLD_THINGS = [["s3:Get*"], ["s3:GetObject", "s3:Put*"], ["*"], ["s3:List?"]], [["arn:part/*"], ["arn:part/one"], ["*"]]


def access_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access document of two statements for each supplier, brought to rules over a world of its own: their number, the witnesses, and both decided on every request."""
    own = Fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))

    def statement(n: Column) -> Column:
        action = F.concat(F.when(n % 7 == 6, '"NotAction": ').otherwise('"Action": '), pick(list(map(json.dumps, _WORLD_ACTIONS)), n))
        thing = F.concat(F.when(n % 5 == 4, '"NotResource": ').otherwise('"Resource": '), pick(list(map(json.dumps, _WORLD_THINGS)), n))
        when = F.when(n % 4 == 2, F.concat(F.lit(', "Condition": {"NumericLessThan": {"line:quantity": '), (F.col("s_nationkey") + 2).cast("string"), F.lit("}}"))).when(n % 4 == 3, ', "Condition": {"StringNotEquals": {"status": ["F", "X"]}}').otherwise("")
        return F.concat(F.lit('{"Effect": "'), F.when(n % 3 == 2, "Deny").otherwise("Allow"), F.lit('", '), action, F.lit(", "), thing, when, F.lit("}"))

    body = F.concat_ws(", ", *(statement(F.col("s_suppkey") * 2 + j) for j in range(2)))
    docs = own.select(F.col("s_suppkey").alias("key"), F.concat(F.lit('{"Statement": ['), body, F.lit("]}")).alias("doc"))
    # Suppliers are a small file, and their documents are work for many tasks.
    spread = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    converted = AI.convert(I.statements(spread, "key", "doc"))
    shown = converted.select("key", "excluded", F.size("rules").cast("long").alias("rules"), F.array_join(F.transform(F.concat("action_witnesses", "resource_witnesses"), lambda w: w["witness"]), ",").alias("witnesses"))
    found = AI.faithfulness(converted)
    return shown.join(by_merge(found), "key", "left").withColumn("rules", F.when(F.isnull("excluded"), F.col("rules")))


def vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: distinct words, and how many of them the benchmark uses."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where("word != ''").distinct()
    used = words(Fx.table(spark, sf_dir, "benchmark")).withColumn("used", F.lit(1))
    own = words(Fx.table(spark, sf_dir, "documents"), "source").join(used, "word", "left")
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("words"), F.count("used").alias("shared"))


def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest prefix of each source's documents, in hash order, that reaches a budget of characters."""
    docs = Fx.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.md5(F.col("doc_id").cast("string")).alias("h"))
    # Sums of hash buckets tell which of them the prefix can reach; only their rows are put in order.
    docs = docs.withColumn("bucket", F.substring("h", 1, 3))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_chars").alias("s"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn("base", F.coalesce(F.sum("s").over(earlier), F.lit(0))).where(f"base < {BUDGET}").drop("s")
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = docs.join(reached, ["source", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("n_chars").over(w), F.lit(0)))
    return kept.where(f"before < {BUDGET}").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


def world_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Fx.table(spark, sf_dir, "documents").select("source", "n_chars")
    return docs.withColumn("test", V.world_split(F.col("source"), 0.3, 11)).groupBy("source", "test").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a manifest in which some are missing, some altered and some extra."""
    from ..sources.storage import compare_manifest

    docs = Fx.table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    manifest = docs.where("doc_id % 17 != 0").select(F.when(F.col("doc_id") % 19 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 13 == 0, F.lit("?")).otherwise(F.col("digest")).alias("digest"))
    return compare_manifest(docs, manifest, "doc_id", "digest").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order-free hash of the documents of each source."""
    from ..sources.storage import tree_digest

    docs = Fx.table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("digest"))
    return tree_digest(docs, ["source"], "doc_id", "digest")


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of document lengths by source, at index int(f * n), from a histogram instead of a sort of the rows."""
    hist = Fx.table(spark, sf_dir, "documents").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source").orderBy("n_chars")
    placed = hist.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("source")))
    at = lambda f: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(f) * F.col("n")), F.col("n") - 1), F.col("n_chars")))
    return placed.groupBy("source").agg(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n_chars").alias("most"))


def url_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each wildcard over hosts, the least host it covers, and how many it covers."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1))
    hosts = Fx.table(spark, sf_dir, "pages").select(host.alias("host")).where("host != ''").distinct()
    patterns = hosts.select(F.concat(F.lit("*."), F.substring_index("host", ".", -2)).alias("pattern")).distinct()
    # The suffix of a pattern is a key, so covering is an equi-join, checked by the pattern itself.
    keyed = hosts.withColumn("suffix", F.substring_index("host", ".", -2))
    both = patterns.withColumn("suffix", F.substring(F.col("pattern"), 3, 1000)).join(keyed, "suffix").where(F.regexp_like("host", I.glob_pattern(F.col("pattern"), True)))
    return both.groupBy("pattern").agg(F.min("host").alias("witness"), F.count(F.lit(1)).alias("covered"))


def _choice(options: list, n: str = "n") -> str:
    return f"{options!r}[n % {len(options)} + 1]"


#: The statements as rows, and each looked at for each request: o is its effect, no, or refused.
_ACCESS = f"""st AS (
  SELECT s_suppkey AS key, j, s_suppkey * 3 + j AS n, CASE WHEN (s_suppkey * 3 + j) % 4 = 3 THEN 'Deny' ELSE 'Allow' END AS effect FROM supplier, (VALUES (0), (1), (2)) v(j)),
sp AS (SELECT *, list_transform({_choice(_ACTIONS)}, lambda x: replace(replace(x, '*', '.*'), '?', '.')) AS acts, list_transform({_choice(_THINGS)}, lambda x: replace(replace(x, '*', '.*'), '?', '.')) AS things,
  bool_or(n % 97 = 0) OVER (PARTITION BY key) AS broken FROM st),
req AS (
  SELECT row_number() OVER () AS line, l_suppkey AS key, CASE l_returnflag WHEN 'R' THEN 's3:GetObject' WHEN 'A' THEN 's3:PutObject' ELSE 'S3:ListX' END AS action, 'arn:part/' || p_brand || '/' || p_partkey AS resource,
    CASE WHEN c_custkey % 2 = 0 THEN 'AWS' ELSE 'Service' END AS who, c_mktsegment AS id, CAST(l_quantity AS BIGINT) AS q, l_linestatus AS st, CASE WHEN l_linenumber != 7 THEN l_extendedprice > 40000 END AS large
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
m AS (
  SELECT r.*, j, effect, broken,
    (len(list_filter(acts, lambda x: regexp_full_match(action, x, 'i'))) > 0) != (n % 11 = 10) AND (len(list_filter(things, lambda x: regexp_full_match(resource, x))) > 0) != (n % 9 = 8)
    AND CASE n % 5 WHEN 2 THEN who = 'AWS' AND id = 'BUILDING' WHEN 3 THEN who = 'Service' AND id IN ('AUTOMOBILE', 'MACHINERY') OR who = 'AWS' AND id = 'HOUSEHOLD' WHEN 4 THEN NOT (who = 'Service' AND id = 'FURNITURE') ELSE true END AS met,
    CASE n % 7 WHEN 2 THEN q < 25 WHEN 3 THEN st IN ('F', 'X') WHEN 4 THEN q NOT IN (1, 2, 3) AND st != 'O' WHEN 5 THEN large WHEN 6 THEN CASE WHEN large IS NULL THEN NULL ELSE large AND q >= 40 END ELSE true END AS held
  FROM req r JOIN sp ON r.key = sp.key),
o AS (SELECT *, CASE WHEN NOT met THEN 'no' WHEN held IS NULL THEN 'refused' WHEN held THEN effect ELSE 'no' END AS o FROM m),
d AS (
  SELECT line, action, bool_or(broken) AS broken, min(j) FILTER (o = 'Deny') AS deny, min(j) FILTER (o = 'refused') AS lost, bool_or(o = 'Allow') AS allow
  FROM o GROUP BY line, action),
f AS (SELECT *, CASE WHEN broken THEN 'effect' WHEN lost IS NOT NULL AND (deny IS NULL OR lost < deny) THEN 'context' END AS refused FROM d)"""

SQL = {
    "parse_short_answer_v1": f"WITH {_ANSWERS.replace('{v2}', 'false').replace('{fold}', 's')} SELECT category, CASE WHEN s IN ('allow', 'deny') THEN s END AS selected, count(*) AS n FROM c GROUP BY ALL",
    "parse_short_answer_v2": f"WITH {_ANSWERS.replace('{v2}', 'true').replace('{fold}', _FOLD)} SELECT category, CASE WHEN s IN ('allow', 'deny') THEN s END AS selected, count(*) AS n FROM c GROUP BY ALL",
    "lenient_selection": f"""WITH {_ANSWERS.replace('{v2}', 'true').replace('{fold}', _FOLD)}, l AS (SELECT *, regexp_matches(s, '(^|[^\\w.])allow([^\\w]|$)') AS a, regexp_matches(s, '(^|[^\\w.])deny([^\\w]|$)') AS d FROM c)
SELECT category, CASE WHEN s IN ('allow', 'deny') THEN s WHEN a AND NOT d THEN 'allow' WHEN d AND NOT a THEN 'deny' END AS lenient, count(*) AS n FROM l GROUP BY ALL""",
    "parse_json_answer": f"""WITH {_OBJECTS} SELECT CASE WHEN k IN (3, 5) THEN 'parse_failure' WHEN d = label THEN 'correct' ELSE 'incorrect' END AS category, CASE WHEN k NOT IN (3, 5) THEN d END AS value, count(*) AS n FROM o GROUP BY ALL""",
    "last_json_answer": """WITH o AS (SELECT length(coalesce(text, '')) % 7 AS k, turn, CASE WHEN turn % 2 = 0 THEN 'allow' ELSE 'deny' END AS d, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'allow' ELSE 'deny' END AS label FROM conversations),
v AS (SELECT label, CASE WHEN turn % 3 = 0 THEN 'allow' WHEN k = 5 THEN NULL ELSE d END AS value FROM o)
SELECT CASE WHEN value IS NULL THEN 'parse_failure' WHEN value = label THEN 'correct' ELSE 'incorrect' END AS category, value, count(*) AS n FROM v GROUP BY ALL""",
    "interpretation_answers": """WITH g AS (SELECT c_nationkey, c_mktsegment, max(c_custkey) AS a, min(c_custkey) AS b FROM customer GROUP BY ALL)
SELECT c_mktsegment, CASE WHEN c_nationkey % 4 = 0 OR a = b THEN 'parse_failure' ELSE 'correct' END AS category, count(*) AS n FROM g GROUP BY ALL""",
    "channel_split": """SELECT turn % 3 != 0 AS found, CASE WHEN turn % 3 != 0 THEN 'so ' || turn ELSE '' END AS text, count(*) AS n, CAST(sum(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))) AS BIGINT) AS thought FROM conversations GROUP BY ALL""",
    "canonical_props": "SELECT event_type, count(*) AS n, count(*) AS ordered, count(DISTINCT props) AS forms FROM events GROUP BY event_type",
    "rendering_round_trips": """WITH r AS (SELECT c_nationkey, c_mktsegment, CASE WHEN min(c_acctbal) < -500 THEN 'forbid' ELSE 'permit' END AS effect, count(*) % 2 = 0 AS two FROM customer GROUP BY ALL)
SELECT effect, count(*) AS n, count(*) AS sentences, count(*) AS rows, CAST(sum(length('Members of nation_' || c_nationkey || CASE effect WHEN 'permit' THEN ' may ' ELSE ' must not ' END || CASE WHEN two THEN 'audit or view' ELSE 'view' END || ' any ' || c_mktsegment || '.')) AS BIGINT) AS sentence_chars,
  CAST(sum(length('| ' || effect || ' | nation_' || c_nationkey || ' | ' || CASE WHEN two THEN 'audit, view' ELSE 'view' END || ' | ' || c_mktsegment || ' |')) AS BIGINT) AS row_chars FROM r GROUP BY effect""",
    "rendering_forms": """WITH r AS (SELECT c_nationkey, c_mktsegment, CASE WHEN min(c_acctbal) < -500 THEN 'forbid' ELSE 'permit' END AS effect FROM customer GROUP BY ALL)
SELECT effect, count(*) AS n, count(*) AS json, count(*) AS duties, CASE effect WHEN 'permit' THEN 0 ELSE count(*) END AS spoilt, CAST(sum(6) AS BIGINT) AS code_lines FROM r GROUP BY effect""",
    "rule_equivalence": """WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) % 12 AS l, count(*) % 12 + CASE WHEN c_nationkey % 3 = 0 AND length(c_mktsegment) % 2 = 0 THEN 1 ELSE 0 END AS m FROM customer GROUP BY c_nationkey, c_mktsegment),
n AS (SELECT c_nationkey, bool_and(l = m) AS exact, count(*) FILTER ((q < l) != (q < m)) AS d, count(*) AS r FROM s, (SELECT unnest(range(0, 10)) AS q) GROUP BY c_nationkey)
SELECT exact, d = 0 AS equivalent, count(*) AS n, CAST(sum(d) AS BIGINT) AS differ, CAST(sum(r) AS BIGINT) AS requests FROM n GROUP BY ALL""",
    "iam_decide": f"WITH {_ACCESS} SELECT action, CASE WHEN refused IS NULL AND deny IS NULL AND allow THEN 'allow' ELSE 'deny' END AS decision, refused, count(*) AS n FROM f GROUP BY ALL",
    "iam_unsupported": f"""SELECT reason, count(*) AS n FROM customer JOIN (VALUES {", ".join(f"({i}, '{r}')" for i, (_, r) in enumerate(_ODD) if r)}) v(i, reason) ON c_custkey % {len(_ODD)} = i GROUP BY reason""",
    "access_import": r"""WITH st AS (SELECT s_suppkey AS key, s_nationkey + 2 AS x, s_suppkey * 2 + j AS n FROM supplier, (VALUES (0), (1)) v(j)),
s AS (SELECT key, x, n, n % 3 = 2 AS deny, n % 7 != 6 AS a_in, [['s3:Get*'], ['s3:GetObject', 's3:Put*'], ['*'], ['s3:List?']][CAST(n % 4 + 1 AS INTEGER)] AS acts, n % 5 != 4 AS r_in, [['arn:part/*'], ['arn:part/one'], ['*']][CAST(n % 3 + 1 AS INTEGER)] AS things FROM st),
av AS (SELECT DISTINCT key, unnest(acts) AS v FROM s), rv AS (SELECT DISTINCT key, unnest(things) AS v FROM s),
am AS (SELECT key, replace(replace(v, '*', 'ZzWitness'), '?', 'z') AS m FROM av UNION SELECT DISTINCT key, 'probe:UnlistedAction' FROM s),
rm AS (SELECT key, replace(replace(v, '*', 'zz-witness'), '?', 'z') AS m FROM rv UNION SELECT DISTINCT key, 'arn:probe:::unlisted-resource' FROM s),
ah AS (SELECT s.key, n, m FROM s JOIN am ON s.key = am.key WHERE (len(list_filter(acts, lambda p: regexp_full_match(m, replace(replace(p, '*', '.*'), '?', '.'), 'i'))) > 0) = a_in),
rh AS (SELECT s.key, n, m FROM s JOIN rm ON s.key = rm.key WHERE (len(list_filter(things, lambda p: regexp_full_match(m, replace(replace(p, '*', '.*'), '?', '.')))) > 0) = r_in),
k AS (SELECT s.*, (SELECT count(*) FROM ah WHERE ah.n = s.n) AS na, (SELECT count(*) FROM rh WHERE rh.n = s.n) AS nr, (SELECT count(*) FROM rm WHERE rm.key = s.key) AS allr FROM s),
kept AS (SELECT * FROM k WHERE na > 0 AND nr > 0),
d AS (SELECT key, count(*) AS kept, CAST(sum(CASE WHEN nr = allr THEN 1 ELSE nr END) AS BIGINT) AS rules FROM kept GROUP BY key),
q AS (SELECT key, unnest(CASE WHEN key % 2 = 0 THEN [0] WHEN EXISTS (SELECT 1 FROM kept WHERE kept.key = s.key AND n % 4 = 2) THEN [x - 1, x, x + 1] ELSE [0] END) AS quantity FROM (SELECT DISTINCT key, x FROM s) s),
w AS (SELECT key, unnest(CASE WHEN key % 2 = 0 THEN ['-'] WHEN EXISTS (SELECT 1 FROM kept WHERE kept.key = s.key AND n % 4 = 3) THEN ['F', 'X', '__unseen__'] ELSE ['__unseen__'] END) AS status FROM (SELECT DISTINCT key FROM s) s),
u AS (SELECT am.key, am.m AS a, rm.m AS r, quantity, status FROM am JOIN rm ON am.key = rm.key JOIN q ON q.key = am.key JOIN w ON w.key = am.key JOIN d ON d.key = am.key),
e AS (SELECT u.key, a, r, quantity, status, max((NOT deny)::INT) AS allow, max(deny::INT) AS deny FROM u LEFT JOIN (SELECT kept.key, kept.n, deny, x, ah.m AS am, rh.m AS rm FROM kept JOIN ah ON ah.n = kept.n JOIN rh ON rh.n = kept.n) h
  ON h.key = u.key AND h.am = a AND h.rm = r AND (h.n % 4 != 2 OR quantity < x) AND (h.n % 4 != 3 OR status NOT IN ('F', 'X')) GROUP BY ALL),
f AS (SELECT key, count(*) AS requests, count(*) FILTER (allow = 1 AND coalesce(deny, 0) = 0) AS allowed FROM e GROUP BY key),
t AS (SELECT key, string_agg(replace(replace(v, '*', t), '?', 'z'), ',' ORDER BY axis, v) AS witnesses FROM (SELECT key, v, 1 AS axis, 'ZzWitness' AS t FROM av UNION ALL SELECT key, v, 2, 'zz-witness' FROM rv) WHERE v LIKE '%*%' OR v LIKE '%?%' GROUP BY key)
SELECT p.key, CASE WHEN d.key IS NULL THEN 'no statement matches' END AS excluded, d.rules, coalesce(witnesses, '') AS witnesses, requests, allowed, CASE WHEN d.key IS NOT NULL THEN 0 END AS mismatches, CASE WHEN d.key IS NOT NULL THEN 0 END AS refusals
FROM (SELECT DISTINCT key FROM s) p LEFT JOIN d USING (key) LEFT JOIN f USING (key) LEFT JOIN t USING (key)""",
    "vocabulary_overlap": """WITH b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark), d AS (SELECT DISTINCT source, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents)
SELECT source, count(*) AS words, count(b.w) AS shared FROM d LEFT JOIN b ON d.w = b.w WHERE d.w != '' GROUP BY source""",
    "prefix_budget": """SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000 GROUP BY source""",
    "world_split": """SELECT source, ('0x' || substr(sha256('11|' || source), 1, 12))::BIGINT / 281474976710656.0 < 0.3 AS test, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL""",
    "manifest_check": """SELECT problem, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN 'extra' WHEN doc_id % 13 = 0 THEN 'mismatched' END AS problem FROM documents
  UNION ALL SELECT 'missing' FROM documents WHERE doc_id % 17 != 0 AND doc_id % 19 = 0) WHERE problem IS NOT NULL GROUP BY problem""",
    "source_digests": """WITH e AS (SELECT source, sha256(CAST(doc_id AS VARCHAR) || chr(0) || md5(text)) AS h FROM documents)
SELECT source, count(*) AS files, sha256(array_to_string([CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 17, 8))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 25, 8))::BIGINT) AS VARCHAR)], '|')) AS sha256 FROM e GROUP BY source""",
    "order_statistics": """WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, max(n_chars) FILTER (i = least(CAST(floor(0.1 * n) AS BIGINT), n - 1)) AS p10, max(n_chars) FILTER (i = least(CAST(floor(0.5 * n) AS BIGINT), n - 1)) AS p50, max(n_chars) FILTER (i = least(CAST(floor(0.9 * n) AS BIGINT), n - 1)) AS p90, max(n_chars) AS most FROM r GROUP BY source""",
    "url_witness": """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages), s AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS suffix FROM h WHERE host != '')
SELECT '*.' || suffix AS pattern, min(host) AS witness, count(*) AS covered FROM s WHERE host LIKE '%.' || suffix GROUP BY suffix""",
}

QUERIES = {f.__name__: f for f in (_short(1), _short(2), lenient_selection, parse_json_answer, last_json_answer, interpretation_answers, channel_split, canonical_props, rendering_round_trips, rendering_forms, rule_equivalence, iam_decide, iam_unsupported, access_import, vocabulary_overlap, prefix_budget, world_split, manifest_check, source_digests, order_statistics, url_witness)}
