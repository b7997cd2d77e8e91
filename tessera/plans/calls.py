"""Queries over function calls, agent turns and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as K
from ..functions import schema_check as J
from . import fixtures as X

_SPEC = '{"name": "log.write", "parameters": {"properties": {"user": {"type": "integer"}, "kind": {"type": "string"}, "value": {"type": "float"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["user", "kind"]}}'


def function_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls, some of them wrong in one way each, against what was wanted."""
    e = X.table(spark, sf_dir, "events")
    k, user, kind = F.col("event_id") % 9, F.col("user_id").cast("string"), F.col("event_type")
    name = F.when(k == 1, "log.read").otherwise("log.write")
    args = F.concat(
        F.lit("user="), F.when(k == 2, F.concat(F.lit("'"), user, F.lit("'"))).otherwise(F.concat(user, F.lit(" + 1 - 1"))), F.when(k == 3, "").otherwise(F.concat(F.lit(", kind='"), F.initcap(kind), F.when(k == 4, "?").otherwise("-"), F.lit("'"))),
        F.when(k == 5, ", extra=1").otherwise(""), F.when(k == 6, "").otherwise(", tags=['A', 'b']"),
    )
    text = F.when(k == 7, "write it").when(k == 8, F.concat(F.lit("[a(x=1), "), name, F.lit("("), args, F.lit(")]"))).otherwise(F.concat(F.lit("`"), name, F.lit("("), args, F.lit(")`")))
    wanted = F.concat(F.lit('{"user": ['), user, F.lit('], "kind": ["'), kind, F.lit('"], "value": ["", 1.0], "tags": [["a", "b"]]}'))
    read = e.select(K.score_calls(text, F.lit(_SPEC), wanted).alias("wrong"), "event_type")
    return read.groupBy("event_type", F.coalesce("wrong", F.lit("right")).alias("result")).agg(F.count(F.lit(1)).alias("n"))


def agent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw agent output: addressed messages, actions in the final channel, and neither."""
    own = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    k = F.length("text") % 5
    item = F.concat(F.lit('{"resource": "r'), (F.col("conv_id") % 10).cast("string"), F.lit('"}'))
    raw = (
        F.when(k == 0, F.concat(F.lit("<|channel|>commentary to=functions.delete <|constrain|>json<|message|>"), item, F.lit("<|call|>")))
        .when(k == 1, F.concat(F.lit("<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>final<|message|>"), F.lit('{"tool": "read", "arguments": '), item, F.lit("}<|return|>")))
        .when(k == 2, F.concat(F.lit("<|channel|>commentary to=write<|message|>no json<|call|>"))).when(k == 3, F.lit("<|channel|>analysis<|message|>cut")).otherwise(F.lit('<|channel|>final<|message|>{"tool": "read"}'))
    )
    read = own.withColumn("a", K.agent_action(raw))
    return read.groupBy(F.col("a.tool").alias("tool"), F.col("a.arguments").alias("arguments")).agg(F.count(F.lit(1)).alias("n"))


def prompt_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as prompts, read back into what they were made of."""
    lines = X.table(spark, sf_dir, "lineitem").join(X.table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    context = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("quantity = "), F.col("l_quantity").cast("bigint").cast("string")), F.concat(F.lit('status = "'), "l_linestatus", F.lit('"'))))
    parts = {"facts": F.col("p_name"), "policy": F.concat(F.lit("Members of r"), F.col("l_returnflag"), F.lit(" may view any part.")), "principal": F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string")), "action": F.lit("view"), "resource": F.concat(F.lit("part::"), F.col("l_partkey").cast("string")), "context": context}
    made = lines.select("l_returnflag", *(c.alias(n) for n, c in parts.items())).withColumn("prompt", K.application_prompt(*(F.col(n) for n in parts)))
    back = made.withColumn("b", K.prompt_parts(F.col("prompt")))
    same = F.col("b").isNotNull()
    for n in parts:
        same = same & (F.col(f"b.{n}") == F.col(n))
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"), F.sum(F.length("prompt")).alias("chars"), F.sum(F.size("b.context")).alias("context_items"))


def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties against schemas: a closed object with an integer, an enumeration, and one whose keys must not repeat."""
    own = X.table(spark, sf_dir, "events").select("event_type", "props")
    whole = {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"], "additionalProperties": False}
    few = {"properties": {"k": {"$ref": "#/$defs/few"}}, "$defs": {"few": {"enum": list(range(0, 100, 3))}}}
    twice = F.when(F.col("props").endswith("7}"), F.concat(F.lit('{"k": 1, '), F.substring("props", F.lit(2), F.length("props")))).otherwise(F.col("props"))
    read = own.withColumns({"a": J.meets(F.col("props"), whole), "b": J.meets(F.col("props"), few), "c": J.meets(twice, whole, True), "d": J.meets(F.concat("props", F.lit("!")), whole)})
    return read.groupBy("event_type").agg(*(F.count_if(c).alias(n) for c, n in zip("abcd", ("whole", "few", "unique_keys", "trailing"))))


SQL = {
    "schema_checks": """SELECT event_type, count(*) AS whole, count(*) FILTER (regexp_extract(props, '([0-9]+)')::INT % 3 = 0) AS few, count(*) FILTER (props NOT LIKE '%7}') AS unique_keys, 0 AS trailing FROM events GROUP BY event_type""",
    "function_calls": """SELECT event_type, ['right', 'name', 'type', 'missing required', 'value', 'unexpected', 'missing optional', 'unreadable', 'count'][CAST(event_id % 9 + 1 AS INTEGER)] AS result, count(*) AS n FROM events GROUP BY ALL""",
    "agent_turns": """WITH k AS (SELECT length(coalesce(text, '')) % 5 AS k, '{"resource": "r' || (conv_id % 10) || '"}' AS item FROM conversations)
SELECT CASE k WHEN 0 THEN 'delete' WHEN 1 THEN 'read' END AS tool, CASE WHEN k < 2 THEN item END AS arguments, count(*) AS n FROM k GROUP BY ALL""",
    "prompt_round_trips": """SELECT l_returnflag, count(*) AS n, count(*) AS same, CAST(sum(length('Facts:' || chr(10) || p_name || chr(10) || chr(10) || 'Policy:' || chr(10) || 'Members of r' || l_returnflag || ' may view any part.' || chr(10) || chr(10) || 'Request: supplier::' || l_suppkey || ' wants to view part::' || l_partkey || ' with context '
  || CASE WHEN l_linenumber % 3 = 0 THEN 'none' ELSE 'quantity = ' || CAST(l_quantity AS BIGINT) || ', status = "' || l_linestatus || '"' END || '. Answer allow or deny.')) AS BIGINT) AS chars, CAST(sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS context_items
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""",
}

QUERIES = {f.__name__: f for f in (function_calls, agent_turns, prompt_round_trips, schema_checks)}
