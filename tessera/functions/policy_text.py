"""Whole policies as text and back: prose, a table, duties by thing acted on, JSON and code, with every kind of scope and condition.

A policy is an array of rules (schemas.RULE). Names are URL-encoded as in forms (a space is +), so that no name holds a space, quote, bar or line break and each form
reads back with one pattern a line, by column expressions alone. Rules come in order of id and actions in order of name. A text that is
not wholly read is null, never a part of a policy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONDITION, RULE, SCOPE

SEMANTICS = "deny unless permitted, forbid overrides"
_WORDS = {"==": "is", "!=": "is not", "<": "is below", "<=": "is at most", ">": "is above", ">=": "is at least"}
_SCOPE = r'anything|exactly \S+::"[^"\s]*"|members of \S+::"[^"\s]*"|any \S+ in \S+::"[^"\s]*"|any \S+'
_OPERAND = r'"[^"\s]*"|[^\s"]+'


def _scope(s: Column) -> Column:
    entity = F.concat(F.url_encode(s["entity"]["type"]), F.lit('::"'), F.url_encode(s["entity"]["id"]), F.lit('"'))
    kind, of = s["kind"], F.url_encode(s["type"])
    return F.when(kind == "any", "anything").when(kind == "eq", F.concat(F.lit("exactly "), entity)).when(kind == "in", F.concat(F.lit("members of "), entity)).when(kind == "is", F.concat(F.lit("any "), of)).when(kind == "is_in", F.concat(F.lit("any "), of, F.lit(" in "), entity))


def _read_scope(t: Column) -> Column:
    part = lambda p, i=1: F.regexp_extract(t, p, i)
    whole = r'\A(?:exactly |members of |any \S+ in )(\S+)::"([^"\s]*)"\z'
    kind = F.when(t == "anything", "any").when(t.startswith("exactly "), "eq").when(t.startswith("members of "), "in").when(F.regexp_like(t, F.lit(r"\Aany \S+ in \S+\z")), "is_in").when(F.regexp_like(t, F.lit(r"\Aany \S+\z")), "is")
    entity = F.when(F.regexp_like(t, F.lit(whole)), F.struct(F.url_decode(part(whole)).alias("type"), F.url_decode(part(whole, 2)).alias("id")))
    return F.struct(kind.alias("kind"), entity.alias("entity"), F.when(kind.isin("is", "is_in"), F.url_decode(part(r"\Aany (\S+)"))).alias("type")).cast(SCOPE)


def _operand(o: Column) -> Column:
    v = o["value"]
    literal = F.when(v["t"] == "str", F.concat(F.lit('"'), F.url_encode(v["s"]), F.lit('"'))).when(v["t"] == "int", v["i"].cast("string")).when(v["t"] == "bool", v["b"].cast("string"))
    return F.coalesce(literal, F.concat(o["subject"], F.lit("."), F.url_encode(o["attr"])))


def _read_operand(t: Column) -> Column:
    none = F.lit(None)
    text, number, flag = t.startswith('"'), F.regexp_like(t, F.lit(r"\A-?\d+\z")), t.isin("true", "false")
    tag = F.when(text, "str").when(number, "int").when(flag, "bool")
    value = F.struct(tag.alias("t"), F.when(text, F.url_decode(F.btrim(t, F.lit('"')))).alias("s"), F.when(number, t.try_cast("bigint")).alias("i"), F.when(flag, t == "true").alias("b"))
    ref = tag.isNull()
    return F.struct(F.when(ref, F.substring_index(t, ".", 1)).alias("subject"), F.when(ref, F.url_decode(F.regexp_extract(t, r"\A[^.]*\.(.*)\z", 1))).alias("attr"), F.when(~ref, value).otherwise(none).alias("value"))


def _conditions(conditions: Column, words: bool, between: str) -> Column:
    def one(c: Column) -> Column:
        op = c["op"]
        if words:
            op = F.element_at(F.create_map(*(F.lit(x) for pair in _WORDS.items() for x in pair)), op)
        return F.concat(_operand(c["left"]), F.lit(" "), op, F.lit(" "), _operand(c["right"]))

    return F.array_join(F.transform(conditions, one), between)


def _read_conditions(t: Column, words: bool, between: str) -> Column:
    """Conditions of a text, null if any is not read; none for an empty text."""
    ops = "|".join(sorted(map(_quote, _WORDS.values() if words else _WORDS), key=len, reverse=True))
    pattern = rf"\A({_OPERAND}) ({ops}) ({_OPERAND})\z"
    sign = F.create_map(*(F.lit(x) for op, word in _WORDS.items() for x in ((word if words else op), op)))
    part = lambda c, i: F.regexp_extract(c, pattern, i)
    one = lambda c: F.struct(_read_operand(part(c, 1)).alias("left"), F.element_at(sign, part(c, 2)).alias("op"), _read_operand(part(c, 3)).alias("right"))
    each = F.split(t, _quote(between))
    read = F.when(F.forall(each, lambda c: F.regexp_like(c, F.lit(pattern))), F.transform(each, one))
    return F.when(t == "", F.array().cast(f"array<{CONDITION}>")).otherwise(read.cast(f"array<{CONDITION}>"))


def _quote(text: str) -> str:
    return "".join("\\" + c if c in "|&.<>=!" else c for c in text)


def _rule(rule_id: Column, effect: Column, principal: Column, actions: Column, resource: Column, conditions: Column) -> Column:
    names = F.transform(actions, lambda a: F.url_decode(a))
    return F.struct(F.url_decode(rule_id).alias("rule_id"), effect.alias("effect"), principal.alias("principal"), names.alias("actions"), resource.alias("resource"), conditions.alias("conditions")).cast(RULE)


def _sorted(rules: Column) -> Column:
    return F.array_sort(rules, lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0))


def _actions(r: Column, between: str) -> Column:
    return F.array_join(F.array_sort(F.transform(r["actions"], lambda a: F.url_encode(a))), between)


def _lines(text: Column, pattern: str, read) -> Column:
    """The rules of a text's lines, null unless every line fits the pattern and its conditions are read."""
    each = F.split(text, "\n")
    rules = F.transform(each, read)
    whole = F.forall(each, lambda t: F.regexp_like(t, F.lit(pattern))) & F.forall(rules, lambda r: r["conditions"].isNotNull())
    return F.when(text == "", F.array().cast(f"array<{RULE}>")).when(whole, rules)


_PROSE = rf"\ARule (\S+): ({_SCOPE}) (may|must not) (\S+(?: or \S+)*) ({_SCOPE})(?: when (.+))?\.\z"


def prose(rules: Column) -> Column:
    """A sentence a rule."""
    def one(r: Column) -> Column:
        when = F.when(F.size(r["conditions"]) > 0, F.concat(F.lit(" when "), _conditions(r["conditions"], True, " and "))).otherwise("")
        return F.concat(F.lit("Rule "), F.url_encode(r["rule_id"]), F.lit(": "), _scope(r["principal"]), F.when(r["effect"] == "permit", " may ").otherwise(" must not "), _actions(r, " or "), F.lit(" "), _scope(r["resource"]), when, F.lit("."))

    return F.array_join(F.transform(_sorted(rules), one), "\n")


def read_prose(text: Column) -> Column:
    def one(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _PROSE, i)
        return _rule(part(1), F.when(part(3) == "may", "permit").otherwise("forbid"), _read_scope(part(2)), F.split(part(4), " or "), _read_scope(part(5)), _read_conditions(part(6), True, " and "))

    return _lines(text, _PROSE, one)


_ROW = rf"\A\| (\S+) \| (permit|forbid) \| ({_SCOPE}) \| (\S+(?:, \S+)*) \| ({_SCOPE}) \| (.*?) ?\|\z"


def table(rules: Column) -> Column:
    """A row a rule: id, effect, principal, actions, resource, conditions."""
    def one(r: Column) -> Column:
        cells = [F.url_encode(r["rule_id"]), r["effect"], _scope(r["principal"]), _actions(r, ", "), _scope(r["resource"])]
        last = F.when(F.size(r["conditions"]) > 0, F.concat(_conditions(r["conditions"], False, " & "), F.lit(" |"))).otherwise("|")
        return F.concat(F.lit("| "), *(x for c in cells for x in (c, F.lit(" | "))), last)

    return F.array_join(F.transform(_sorted(rules), one), "\n")


def read_table(text: Column) -> Column:
    def one(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _ROW, i)
        return _rule(part(1), part(2), _read_scope(part(3)), F.split(part(4), ", "), _read_scope(part(5)), _read_conditions(part(6), False, " & "))

    return _lines(text, _ROW, one)


_DUTY = rf"\A({_SCOPE}) (lets|bars) ({_SCOPE}) \[(\S+)\] by (\S+)(?: where (.+))?\z"


def duties(rules: Column) -> Column:
    """A line for each rule and action, from the side of the thing acted on."""
    def one(r: Column) -> Column:
        where = F.when(F.size(r["conditions"]) > 0, F.concat(F.lit(" where "), _conditions(r["conditions"], True, " and "))).otherwise("")
        line = lambda a: F.concat(_scope(r["resource"]), F.when(r["effect"] == "permit", " lets ").otherwise(" bars "), _scope(r["principal"]), F.lit(" ["), F.url_encode(a), F.lit("] by "), F.url_encode(r["rule_id"]), where)
        return F.transform(F.array_sort(r["actions"]), line)

    return F.array_join(F.flatten(F.transform(_sorted(rules), one)), "\n")


def read_duties(text: Column) -> Column:
    """The rules behind such lines; null where lines of one rule differ in more than the action."""
    def one(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _DUTY, i)
        return _rule(part(5), F.when(part(2) == "lets", "permit").otherwise("forbid"), _read_scope(part(3)), F.array(part(4)), _read_scope(part(1)), _read_conditions(part(6), True, " and "))

    lines = _lines(text, _DUTY, one)
    bare = F.array_distinct(F.transform(lines, lambda r: r.withField("actions", F.array().cast("array<string>"))))
    own = lambda r: F.array_sort(F.flatten(F.transform(F.filter(lines, lambda x: x["rule_id"] == r["rule_id"]), lambda x: x["actions"])))
    same = F.size(bare) == F.size(F.array_distinct(F.transform(bare, lambda r: r["rule_id"])))
    return F.when(same, F.transform(bare, lambda r: r.withField("actions", own(r))))


def as_json(rules: Column) -> Column:
    """An object that states how rules combine, then the rules."""
    each = F.transform(_sorted(rules), lambda r: r.withField("actions", F.array_sort(r["actions"])))
    return F.to_json(F.struct(F.lit(SEMANTICS).alias("semantics"), each.alias("rules")))


def read_json(text: Column) -> Column:
    """The rules of such an object; null if it is none or states other semantics."""
    read = F.from_json(text, f"struct<semantics:string,rules:array<{RULE}>>", {"allowSingleQuotes": "false"})
    return F.when(read["semantics"] == SEMANTICS, read["rules"])


def code(rules: Column) -> Column:
    """A statement a rule: effect, scopes of principal, action and resource, and a when clause."""
    def scope(name: str, s: Column) -> Column:
        entity = F.concat(F.url_encode(s["entity"]["type"]), F.lit('::"'), F.url_encode(s["entity"]["id"]), F.lit('"'))
        kind, of = s["kind"], F.url_encode(s["type"])
        after = F.when(kind == "any", "").when(kind == "eq", F.concat(F.lit(" == "), entity)).when(kind == "in", F.concat(F.lit(" in "), entity)).when(kind == "is", F.concat(F.lit(" is "), of)).otherwise(F.concat(F.lit(" is "), of, F.lit(" in "), entity))
        return F.concat(F.lit(name), after)

    def one(r: Column) -> Column:
        named = F.array_join(F.transform(F.array_sort(r["actions"]), lambda a: F.concat(F.lit('Action::"'), F.url_encode(a), F.lit('"'))), ", ")
        when = F.when(F.size(r["conditions"]) > 0, F.concat(F.lit(" when { "), _conditions(r["conditions"], False, " && "), F.lit(" }"))).otherwise("")
        return F.concat(F.lit('@id("'), F.url_encode(r["rule_id"]), F.lit('") '), r["effect"], F.lit(" ("), scope("principal", r["principal"]), F.lit(", action in ["), named, F.lit("], "), scope("resource", r["resource"]), F.lit(")"), when, F.lit(";"))

    return F.array_join(F.transform(_sorted(rules), one), "\n")


def normal_form(rules: Column) -> Column:
    """What an array of rules says, free of rule ids and order: one key for each rule and action, with conditions in order of text."""
    def one(r: Column) -> Column:
        conditions = F.array_join(F.array_sort(F.transform(r["conditions"], lambda c: F.concat_ws(" ", _operand(c["left"]), c["op"], _operand(c["right"])))), " & ")
        return F.transform(r["actions"], lambda a: F.concat_ws("|", r["effect"], _scope(r["principal"]), F.url_encode(a), _scope(r["resource"]), conditions))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(rules, one))))
