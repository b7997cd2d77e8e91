"""Rule sets as models state them in JSON, written and read back strictly by column expressions.

An object {"rules": [..]} whose rules have exactly the fields below. A text that departs from it anywhere holds no rules: it is a refusal, an
abstention or a parse failure, told apart by the answer's wording.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONDITION, ENTITY, OPERAND, RULE, SCOPE, VALUE
from .binding import let
from .text import ABSTAIN, REFUSAL, after_thoughts, fold, object_text

#: How a scope is named, the kind it stands for, and the fields it has beside its name.
MATCHES = {"any": ("any", ()), "exactly": ("eq", ("entity",)), "any_of_type": ("is", ("type",)), "entity_or_member_of": ("in", ("entity",)), "type_and_member_of": ("is_in", ("type", "entity"))}
FIELDS = ("id", "effect", "principal", "actions", "resource", "conditions_mode", "conditions")
OPERATORS = ("==", "!=", "<", "<=", ">", ">=")
SUBJECTS = ("principal", "resource", "context")


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _listed(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def as_reading(rules: Column) -> Column:
    """The text of an array of rules, in order of id, with actions sorted: what a perfect answer is."""
    kinds = F.create_map(*(F.lit(x) for name, (kind, _) in MATCHES.items() for x in (kind, name)))

    def scope(s: Column) -> Column:
        entity = F.concat(F.lit(', "entity": {"type": '), _quoted(s["entity"]["type"]), F.lit(', "id": '), _quoted(s["entity"]["id"]), F.lit("}"))
        typed = F.when(s["kind"].isin("is", "is_in"), F.concat(F.lit(', "type": '), _quoted(s["type"]))).otherwise("")
        return F.concat(F.lit('{"match": "'), F.element_at(kinds, s["kind"]), F.lit('"'), typed, F.when(s["kind"].isin("eq", "in", "is_in"), entity).otherwise(""), F.lit("}"))

    def operand(o: Column) -> Column:
        v = o["value"]
        literal = F.when(v["t"] == "str", _quoted(v["s"])).when(v["t"] == "int", v["i"].cast("string")).when(v["t"] == "bool", v["b"].cast("string"))
        return F.coalesce(literal, F.concat(F.lit('{"attr": '), _quoted(F.concat(o["subject"], F.lit("."), o["attr"])), F.lit("}")))

    def one(r: Column) -> Column:
        conditions = F.transform(r["conditions"], lambda c: F.concat(F.lit('{"left": '), operand(c["left"]), F.lit(', "op": "'), c["op"], F.lit('", "right": '), operand(c["right"]), F.lit("}")))
        effect = F.when(r["effect"] == "permit", "allow").otherwise("deny")
        return F.concat(
            F.lit('{"id": '), _quoted(r["rule_id"]), F.lit(', "effect": "'), effect, F.lit('", "principal": '), scope(r["principal"]), F.lit(', "actions": '), _listed(F.transform(F.array_sort(r["actions"]), _quoted)),
            F.lit(', "resource": '), scope(r["resource"]), F.lit(', "conditions_mode": "all", "conditions": '), _listed(conditions), F.lit("}"),
        )

    ordered = F.array_sort(rules, lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0))
    return F.concat(F.lit('{"rules": '), _listed(F.transform(ordered, one)), F.lit("}"))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _text(v: Column) -> Column:
    """A string that is not empty."""
    return F.when((F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") != ""), F.try_variant_get(v, "$", "string"))


def _only(m: Column, *names: str) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, sorted(names))), F.lit(False))


def _get(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def _entity(v: Column) -> Column:
    def read(m):
        kind, name = _text(_get(m, "type")), _text(_get(m, "id"))
        return F.when(_only(m, "type", "id") & kind.isNotNull() & name.isNotNull(), F.struct(kind.alias("type"), name.alias("id")).cast(ENTITY))

    return let(_fields(v), read)


def _scope(v: Column) -> Column:
    def read(m):
        parts = F.struct(_text(_get(m, "match")).alias("match"), _entity(_get(m, "entity")).alias("entity"), _text(_get(m, "type")).alias("type"), F.array_sort(F.map_keys(m)).alias("fields"))

        def judge(x):
            kind = F.lit(None).cast("string")
            for name, (own, fields) in MATCHES.items():
                whole = (x["match"] == name) & (x["fields"] == F.array(*map(F.lit, sorted(("match", *fields)))))
                for f in fields:
                    whole = whole & x[f].isNotNull()
                kind = F.when(whole, own).otherwise(kind)
            return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), x["entity"].alias("entity"), x["type"].alias("type")).cast(SCOPE))

        return let(parts, judge)

    return let(_fields(v), read)


def _operand(v: Column) -> Column:
    def read(m):
        kind, name = F.schema_of_variant(v), F.try_variant_get(_get(m, "attr"), "$", "string")
        subject, attr = F.substring_index(name, ".", 1), F.regexp_extract(name, r"(?s)\A[^.]*\.(.+)\z", 1)
        named = _only(m, "attr") & (F.schema_of_variant(_get(m, "attr")) == "STRING") & subject.isin(*SUBJECTS) & (attr != "")
        whole = (kind == "BIGINT") | F.regexp_like(kind, F.lit(r"\ADECIMAL\(\d+,0\)\z"))
        number = F.when(whole, F.try_variant_get(v, "$", "bigint"))
        text = lambda t: F.lit(t).cast("string")
        value = F.when(kind == "STRING", F.struct(text("str").alias("t"), F.try_variant_get(v, "$", "string").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("boolean").alias("b")))
        value = value.when(number.isNotNull(), F.struct(text("int").alias("t"), text(None).alias("s"), number.alias("i"), F.lit(None).cast("boolean").alias("b")))
        value = value.when(kind == "BOOLEAN", F.struct(text("bool").alias("t"), text(None).alias("s"), F.lit(None).cast("bigint").alias("i"), F.try_variant_get(v, "$", "boolean").alias("b")))
        ref = F.struct(subject.alias("subject"), attr.alias("attr"), F.lit(None).cast(VALUE).alias("value")).cast(OPERAND)
        plain = F.struct(text(None).alias("subject"), text(None).alias("attr"), value.cast(VALUE).alias("value")).cast(OPERAND)
        return F.when(named, ref).when(value.isNotNull(), plain)

    return let(_fields(v), read)


def _condition(v: Column) -> Column:
    def read(m):
        left, right, op = _operand(_get(m, "left")), _operand(_get(m, "right")), _text(_get(m, "op"))
        whole = _only(m, "left", "op", "right") & op.isin(*OPERATORS) & left["subject"].isNotNull() & right.isNotNull()
        return F.when(whole, F.struct(left.alias("left"), op.alias("op"), right.alias("right")).cast(CONDITION))

    return let(_fields(v), read)


def _rule(v: Column) -> Column:
    def read(m):
        effect, name, mode = _text(_get(m, "effect")), _text(_get(m, "id")), _text(_get(m, "conditions_mode"))
        actions = F.transform(F.try_variant_get(_get(m, "actions"), "$", "array<variant>"), _text)
        conditions = F.transform(F.try_variant_get(_get(m, "conditions"), "$", "array<variant>"), _condition)
        who, what = _scope(_get(m, "principal")), _scope(_get(m, "resource"))
        full = lambda a: a.isNotNull() & ~F.exists(a, lambda x: x.isNull())
        whole = _only(m, *FIELDS) & name.isNotNull() & effect.isin("allow", "deny") & (mode == "all") & full(actions) & (F.size(actions) > 0) & full(conditions) & who.isNotNull() & what.isNotNull()
        rule = F.struct(name.alias("rule_id"), F.when(effect == "allow", "permit").otherwise("forbid").alias("effect"), who.alias("principal"), F.array_sort(F.array_distinct(actions)).alias("actions"), what.alias("resource"), conditions.alias("conditions"))
        return F.when(whole, rule.cast(RULE))

    return let(_fields(v), read)


def read_reading(text: Column, version: int = 3) -> Column:
    """struct(category, rules): rules, an array of schemas.RULE, where category is `rules`; else null and category is refusal, abstain or parse_failure."""
    rest = after_thoughts(F.coalesce(text, F.lit("")), version)
    plain = fold(rest)

    def judge(v):
        m = _fields(v)
        each = F.when(_only(m, "rules"), F.transform(F.try_variant_get(_get(m, "rules"), "$", "array<variant>"), _rule))
        rules = F.when(each.isNotNull() & ~F.exists(each, lambda r: r.isNull()), each)
        return let(rules, lambda r: F.struct(F.when(r.isNotNull(), "rules").when(F.regexp_like(plain, F.lit("(?iU)" + REFUSAL)), "refusal").when(m.isNull() & F.regexp_like(plain, F.lit("(?iU)" + ABSTAIN)), "abstain").otherwise("parse_failure").alias("category"), r.alias("rules")))

    return let(F.try_parse_json(object_text(rest)), judge)
