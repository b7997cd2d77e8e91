"""Access documents in JSON statements with wildcards: parsing, support checks and decisions, an explicit deny first.

A document is parsed once to an array of statements with its wildcards already sorted into plain texts, prefixes and patterns, so that
requests, which meet it in one join on its key, are matched within their row. Whatever is not understood refuses the whole document:
its requests are denied and say why, as are those that lack a key which a condition asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VALUE
from ..sources.storage import written

#: Condition operators and the type of what they compare.
OPERATORS = {
    "StringEquals": "str", "StringNotEquals": "str", "NumericEquals": "int", "NumericNotEquals": "int", "NumericLessThan": "int",
    "NumericLessThanEquals": "int", "NumericGreaterThan": "int", "NumericGreaterThanEquals": "int", "Bool": "bool",
}
NEGATED = ("StringNotEquals", "NumericNotEquals")
_LAST_KEY = "spark.sql.variant.allowDuplicateKeys"

REQUEST = f"key, action string, resource string, principal struct<type:string,id:string>, context map<string,{VALUE}>"


def glob_pattern(glob: Column, fold_case: bool) -> Column:
    """The regular expression of a wildcard pattern: * any run, ? one character, all else as written. Without fold_case wildcards end at a line break."""
    quoted = F.regexp_replace(glob, r"([^A-Za-z0-9_*?])", r"\\$1")
    any_one = "." if fold_case else r"[^\n]"
    body = F.replace(F.replace(quoted, F.lit("?"), F.lit(any_one)), F.lit("*"), F.lit(any_one + "*"))
    return F.concat(F.lit(r"(?isu)\A" if fold_case else r"\A"), body, F.lit(r"\z"))


def _glob(glob: Column, fold_case: bool) -> Column:
    """kind (plain, prefix, pattern) and text of a wildcard, so that most need no regular expression."""
    plain = F.lower(glob) if fold_case else glob
    kind = F.when(~F.regexp_like(glob, F.lit(r"[*?]")), "plain").when(F.regexp_like(glob, F.lit(r"\A[^*?]*\*\z")), "prefix").otherwise("pattern")
    text = F.when(kind == "plain", plain).when(kind == "prefix", F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(glob_pattern(glob, fold_case))
    return F.struct(kind.alias("kind"), text.alias("text"), glob_pattern(glob, fold_case).alias("pattern"))


def _matches(g: Column, value: Column, fold_case: bool) -> Column:
    own = F.lower(value) if fold_case else value
    one_line = F.lit(True) if fold_case else ~F.contains(value, F.lit("\n"))
    return F.when(g["kind"] == "plain", own == g["text"]).when((g["kind"] == "prefix") & one_line, F.startswith(own, g["text"])).otherwise(F.regexp_like(value, g["pattern"]))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _list(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _texts(v: Column) -> Column:
    """The strings of a value or list; null if there is anything else."""
    each = _list(v)
    return F.when(F.forall(each, lambda x: _kind(x) == "STRING"), F.transform(each, lambda x: F.try_variant_get(x, "$", "string")))


def _people(v: Column) -> Column:
    """(type, id) of an object of principals by type; id is null for what is no string. Null if v is no object."""
    return F.flatten(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.transform(_list(e["value"]), lambda x: F.struct(e["key"].alias("type"), F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).alias("id")))))


def _wild(p: Column) -> Column:
    return p["id"].isNull() | F.regexp_like(F.coalesce(p["id"], F.lit("")), F.lit(r"[*?]"))


def _read(op: Column, v: Column) -> Column:
    """A condition value as the operator's type, null if it is none: integers and truth values may be written as strings."""
    want = F.element_at(F.create_map(*(F.lit(x) for kv in OPERATORS.items() for x in kv)), op)
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    number = F.when((kind == "BIGINT") | (kind == "STRING") & F.regexp_like(text, F.lit(r"\A-?[0-9]+\z")), text.try_cast("bigint"))
    flag = F.when((kind == "BOOLEAN") | (kind == "STRING") & F.lower(text).isin("true", "false"), F.lower(text) == "true")
    none = lambda t: F.lit(None).cast(t)
    value = lambda t, s, i, b: F.struct(F.lit(t).alias("t"), s.alias("s"), i.alias("i"), b.alias("b"))
    return (
        F.when((want == "str") & (kind == "STRING"), value("str", text, none("bigint"), none("boolean")))
        .when((want == "int") & number.isNotNull(), value("int", none("string"), number, none("boolean")))
        .when((want == "bool") & flag.isNotNull(), value("bool", none("string"), none("bigint"), flag))
    )


def _block_orders(text: Column) -> Column:
    """For each statement of a document's text, its condition operators and their keys in the order they are written; a key that is written twice stands where it is first."""
    blocks = "struct<Condition:map<string,map<string,string>>>"
    many, one = F.from_json(text, f"struct<Statement:array<{blocks}>>")["Statement"], F.from_json(text, f"struct<Statement:{blocks}>")["Statement"]
    order = lambda s: F.transform(F.map_entries(s["Condition"]), lambda b: F.struct(b["key"].alias("op"), F.map_keys(b["value"]).alias("keys")))
    return F.when(F.size(many) > 0, F.transform(many, order)).otherwise(F.array(order(one)))


def _in_order(wanted: Column, order: Column) -> Column:
    """Conditions (op, key, values) in the order of (op, keys) lists."""
    flat = F.flatten(F.transform(order, lambda o: F.transform(o["keys"], lambda k: F.concat_ws("\n", o["op"], k))))
    placed = F.transform(wanted, lambda c: F.struct(F.array_position(flat, F.concat_ws("\n", c["op"], c["key"])).alias("at"), c.alias("c")))
    return F.transform(F.array_sort(placed, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda x: x["c"])


def statements(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, refused, statements): each JSON document's statements, and why it is refused as a whole, null if it is not. Parsed once and written out.

    Conditions keep the order of the text, and of a key that stands twice in an object the last value counts, as JSON readers have it.

    Single values and single statements count as lists of one. refused: json, statement, variable, effect, action, resource, principal or
    condition, that of the first statement that is outside the subset.
    """
    spark = documents.sparkSession
    before = spark.conf.get(_LAST_KEY)
    # Read when the expression is resolved, so for this one alone.
    spark.conf.set(_LAST_KEY, "true")
    try:
        doc = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.try_parse_json(text).alias("v"), _block_orders(F.col(text)).alias("orders"))
    finally:
        spark.conf.set(_LAST_KEY, before)
    doc = doc.withColumn("found", F.try_variant_get("v", "$.Statement", "variant"))
    each = doc.withColumn("ss", F.transform(F.when(F.col("found").isNotNull(), _list(F.col("found"))), lambda s: F.try_variant_get(s, "$", "map<string,variant>")))

    def one(s: Column, at: Column) -> Column:
        get = lambda name: F.try_element_at(s, F.lit(name))
        has = lambda name: F.coalesce(F.map_contains_key(s, name), F.lit(False))
        acts, things = (_texts(F.coalesce(get(n), get("Not" + n))) for n in ("Action", "Resource"))
        who, not_who = _people(get("Principal")), _people(get("NotPrincipal"))
        star = lambda p: (p["type"] == "AWS") & (p["id"] == "*")
        everyone = (F.coalesce(_kind(get("Principal")) == "STRING", F.lit(False)) & (F.try_variant_get(get("Principal"), "$", "string") == "*")) | F.coalesce(F.exists(who, star), F.lit(False))
        labels = F.transform(who, lambda p: F.when(star(p), "star").when(_wild(p), "odd").otherwise("one"))
        odd_who = F.when(_kind(get("Principal")) == "STRING", F.try_variant_get(get("Principal"), "$", "string") != "*").when(who.isNull(), True).otherwise(
            (F.array_position(labels, "odd") > 0) & ((F.array_position(labels, "star") == 0) | (F.array_position(labels, "odd") < F.array_position(labels, "star"))))
        odd_not = F.when(not_who.isNull() | (F.size(F.map_keys(F.try_variant_get(get("NotPrincipal"), "$", "map<string,variant>"))) == 0), True).otherwise(F.exists(not_who, lambda p: (p["type"] != "Service") | _wild(p)))
        blocks = F.map_entries(F.try_variant_get(get("Condition"), "$", "map<string,variant>"))
        wanted = F.transform(blocks, lambda b: F.transform(F.map_entries(F.try_variant_get(b["value"], "$", "map<string,variant>")), lambda kv: F.struct(b["key"].alias("op"), kv["key"].alias("key"), F.transform(_list(kv["value"]), lambda x: _read(b["key"], x)).alias("values"))))
        odd_block = F.exists(F.coalesce(blocks, F.array()), lambda b: ~b["key"].isin(*OPERATORS) | F.try_variant_get(b["value"], "$", "map<string,variant>").isNull())
        odd_when = has("Condition") & (blocks.isNull() | odd_block | F.exists(F.coalesce(F.flatten(wanted), F.array()), lambda c: (F.size(c["values"]) == 0) | F.exists(c["values"], lambda x: x.isNull())))
        effect = F.when(_kind(get("Effect")) == "STRING", F.try_variant_get(get("Effect"), "$", "string"))
        no = F.lit(False)
        reason = (
            F.when(s.isNull(), "statement").when(~F.coalesce(effect.isin("Allow", "Deny"), no), "effect")
            .when((has("Action") == has("NotAction")) | acts.isNull(), "action").when((has("Resource") == has("NotResource")) | things.isNull(), "resource")
            .when(has("Principal") & has("NotPrincipal") | has("Principal") & F.coalesce(odd_who, F.lit(True)) | has("NotPrincipal") & F.coalesce(odd_not, F.lit(True)), "principal")
            .when(F.coalesce(odd_when, F.lit(True)), "condition")
        )
        return F.struct(
            reason.alias("reason"), effect.alias("effect"), has("Action").alias("action_in"), F.transform(acts, lambda g: _glob(g, True)).alias("actions"),
            acts.alias("action_texts"), things.alias("resource_texts"), (has("Principal") | has("NotPrincipal")).alias("named"),
            has("Resource").alias("resource_in"), F.transform(things, lambda g: _glob(g, False)).alias("resources"),
            F.when(has("NotPrincipal"), "none of").when(has("Principal") & ~everyone, "one of").otherwise("all").alias("who"), F.coalesce(who, not_who).alias("people"),
            F.coalesce(_in_order(F.flatten(wanted), F.coalesce(F.get("orders", at), F.array())), F.array()).alias("conditions"),
        )

    parsed = each.withColumn("statements", F.transform("ss", one))
    first = F.get(F.filter(F.transform("statements", lambda s: s["reason"]), lambda r: r.isNotNull()), F.lit(0))
    refused = F.when(F.col("v").isNull(), "json").when(F.col("ss").isNull(), "statement").when(F.contains("text", F.lit("${")), "variable").otherwise(first)
    return written(parsed.select("key", refused.alias("refused"), "statements"))


def unsupported(docs: DataFrame) -> DataFrame:
    """(key, reason) of documents that are refused."""
    return docs.select("key", F.col("refused").alias("reason")).where("reason is not null")


def _condition(c: Column, context: Column) -> Column:
    """yes, no, or refused where the request lacks the key or has a value of another type."""
    got, op = F.try_element_at(context, c["key"]), c["op"]

    def test(x: Column) -> Column:
        i = got["i"]
        order = F.when(op == "NumericLessThan", i < x["i"]).when(op == "NumericLessThanEquals", i <= x["i"]).when(op == "NumericGreaterThan", i > x["i"]).when(op == "NumericGreaterThanEquals", i >= x["i"])
        return order.when(got["t"] == "str", got["s"] == x["s"]).when(got["t"] == "int", i == x["i"]).otherwise(got["b"] == x["b"])

    hit = F.exists(c["values"], test)
    known = got.isNotNull() & (got["t"] == F.get(c["values"], F.lit(0))["t"])
    return F.when(~F.coalesce(known, F.lit(False)), "refused").when(F.when(op.isin(*NEGATED), ~hit).otherwise(hit), "yes").otherwise("no")


def decide(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """requests (key, action, resource, principal struct<type,id>, context map to tagged values, ..) with decision and refused.

    Statements and their conditions are looked at in the order of the text: a deny, or a condition that cannot be judged, settles the
    request where it comes first; what is refused is denied. A document that does not exist denies.
    """
    joined = requests.join(docs.withColumnRenamed("refused", "_why"), "key", "left")
    who = F.col("principal")

    def result(s: Column) -> Column:
        listed = F.exists(s["people"], lambda p: (p["type"] == who["type"]) & (p["id"] == who["id"]))
        listed = F.coalesce(listed, F.lit(False))
        person = F.when(s["who"] == "all", True).when(s["who"] == "one of", listed).otherwise(~listed)
        hit = lambda globs, value, fold: F.exists(globs, lambda g: _matches(g, value, fold))
        act = F.when(s["action_in"], hit(s["actions"], F.col("action"), True)).otherwise(~hit(s["actions"], F.col("action"), True))
        thing = F.when(s["resource_in"], hit(s["resources"], F.col("resource"), False)).otherwise(~hit(s["resources"], F.col("resource"), False))
        held = F.aggregate(s["conditions"], F.lit("yes"), lambda acc, c: F.when(acc == "yes", _condition(c, F.col("context"))).otherwise(acc))
        reached = F.when(person & act & thing, held).otherwise("no")
        return F.when(reached == "yes", s["effect"]).otherwise(reached)

    found = joined.withColumn("_r", F.when(F.col("_why").isNull(), F.transform("statements", result)))
    lost, denied = F.array_position("_r", "refused"), F.array_position("_r", "Deny")
    refused = F.when(F.col("statements").isNull() & F.col("_why").isNull(), "no document").when(F.col("_why").isNotNull(), F.col("_why")).when((lost > 0) & ((denied == 0) | (lost < denied)), "context")
    out = found.withColumn("refused", refused)
    decision = F.when(F.col("refused").isNotNull() | (F.array_position("_r", "Deny") > 0), "deny").when(F.array_position("_r", "Allow") > 0, "allow").otherwise("deny")
    return out.withColumn("decision", decision).drop("_r", "_why", "statements")
