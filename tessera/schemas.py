"""Schemas of the policy model. A value carries its type, so that true and 1 never meet in a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<t:string,s:string,i:bigint,b:boolean>"
ENTITY = "struct<type:string,id:string>"
SCOPE = f"struct<kind:string,entity:{ENTITY},type:string>"
OPERAND = f"struct<subject:string,attr:string,value:{VALUE}>"
CONDITION = f"struct<left:{OPERAND},op:string,right:{OPERAND}>"
RULE = f"struct<rule_id:string,effect:string,principal:{SCOPE},actions:array<string>,resource:{SCOPE},conditions:array<{CONDITION}>>"
RULES = f"policy_id string, rule {RULE}"

CATEGORIES = ("correct", "incorrect", "refusal", "abstain", "parse_failure")
RENDERINGS = ("executable", "json", "nl", "owner", "rego", "table")


def value(x: object) -> tuple:
    """A Python literal as a tagged value; bool is looked at before int."""
    if isinstance(x, bool):
        return "bool", None, None, x
    return ("int", None, x, None) if isinstance(x, int) else ("str", x, None, None)


def text_value(c: Column) -> Column:
    return F.struct(F.lit("str").alias("t"), c.cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("boolean").alias("b"))


def int_value(c: Column) -> Column:
    return F.struct(F.lit("int").alias("t"), F.lit(None).cast("string").alias("s"), c.cast("bigint").alias("i"), F.lit(None).cast("boolean").alias("b"))


def bool_value(c: Column) -> Column:
    return F.struct(F.lit("bool").alias("t"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("bigint").alias("i"), c.cast("boolean").alias("b"))


def any_scope() -> tuple:
    return "any", None, None


def eq_scope(kind: str, id_: str) -> tuple:
    return "eq", (kind, id_), None


def is_scope(kind: str) -> tuple:
    return "is", None, kind


def in_scope(kind: str, id_: str, typed: str | None = None) -> tuple:
    """Members of an entity, itself among them; typed: only those of one type."""
    return "is_in" if typed else "in", (kind, id_), typed


def attr(subject: str, name: str) -> tuple:
    return subject, name, None


def literal(x: object) -> tuple:
    return None, None, value(x)


def rule(rule_id: str, effect: str, principal: tuple, actions: list[str], resource: tuple, *conditions: tuple) -> tuple:
    """conditions: (left operand, operator, right operand)."""
    return rule_id, effect, principal, actions, resource, list(conditions)
