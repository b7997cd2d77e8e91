"""Access documents as canonical policies over a closed world of their own, and the test that both decide alike.

A document's world: every concrete action and resource it names, one witness for each wildcard, the principals it names, and one of each that it does not
name. Statements become rules over that world: what wildcards and Not-elements cover is spelled out, condition blocks are brought to
alternatives of conjunctions. Documents are judged each in its row; the differential test spreads their requests over rows. What cannot be
translated is excluded with a reason, never approximated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..schemas import CONDITION, RULE, SCOPE, VALUE
from ..sources.storage import by_merge, written
from . import equivalence, iam, policy

#: What stands for a wildcard, in order of preference.
WITNESS_TOKENS = {"action": ("ZzWitness", "QqWitness", "XxWitness", "JjWitness", "VvWitness"), "resource": ("zz-witness", "qq-witness", "xx-witness", "jj-witness", "vv-witness")}
MOST_RULES, MOST_REQUESTS = 64, 20_000
PROBES = {"action": "probe:UnlistedAction", "resource": "arn:probe:::unlisted-resource"}
CALLER, STRANGER, ANYONE = ("Caller", "caller"), ("AWS", "arn:aws:iam::000000000000:user/unlisted"), ("AWS", "arn:aws:iam::000000000000:user/anyone")
PRINCIPAL, RESOURCE = "Principal", "Resource"
_TESTS = {"StringEquals": "==", "StringNotEquals": "!=", "NumericEquals": "==", "NumericNotEquals": "!=", "NumericLessThan": "<", "NumericLessThanEquals": "<=", "NumericGreaterThan": ">", "NumericGreaterThanEquals": ">=", "Bool": "=="}
_NONE = "array<string>"


def safe_id(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit(":"), F.lit(".")), "[^A-Za-z0-9_.-]", "_")


def safe_attr(name: Column) -> Column:
    return let(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), lambda s: F.when(F.regexp_like(s, F.lit("^[A-Za-z_]")), s).otherwise(F.concat(F.lit("k_"), s)))


def _wild(x: Column) -> Column:
    return F.regexp_like(x, F.lit("[*?]"))


def _folded(x: Column, fold: bool) -> Column:
    return F.lower(x) if fold else x


def _fits(glob: Column, value: Column, fold: bool) -> Column:
    return F.regexp_like(value, iam.glob_pattern(glob, fold))


def _first_spelling(values: Column, fold: bool) -> Column:
    """Values with one of each folded form, the first."""
    if not fold:
        return F.array_distinct(values)
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, F.lower), F.lower(x)) == i + 1)


def witnesses(patterns: Column, taken: Column, axis: str) -> Column:
    """array<struct<pattern, witness, also>>, in order of pattern: a member for each wildcard pattern that none before it has, chosen to meet the fewest other patterns.

    Each choice is taken from the next. also: the other patterns that it meets all the same. witness is null where all tokens are taken.
    """
    fold, tokens = axis == "action", WITNESS_TOKENS[axis]
    row = "struct<pattern:string,witness:string,also:array<string>>"
    start = F.struct(F.transform(taken, lambda x: _folded(x, fold)).alias("taken"), F.array().cast(f"array<{row}>").alias("rows"))

    def choose(state: Column, pattern: Column) -> Column:
        def candidate(token: Column, i: Column) -> Column:
            own = F.replace(F.replace(pattern, F.lit("*"), token), F.lit("?"), F.lower(F.left(token, F.lit(1))))
            also = lambda w: F.array_sort(F.filter(patterns, lambda o: (o != pattern) & _fits(o, w, fold)))
            free = lambda w: ~F.array_contains(state["taken"], _folded(w, fold)) & _fits(pattern, w, fold)
            return let(own, lambda w: F.when(free(w), let(also(w), lambda a: F.struct(F.size(a).alias("n"), i.alias("i"), w.alias("w"), a.alias("a")))))

        best = F.array_min(F.filter(F.transform(F.array(*map(F.lit, tokens)), candidate), lambda x: x.isNotNull()))
        return let(best, lambda b: F.struct(F.when(b.isNotNull(), F.array_append(state["taken"], _folded(b["w"], fold))).otherwise(state["taken"]).alias("taken"), F.array_append(state["rows"], F.struct(pattern.alias("pattern"), b["w"].alias("witness"), b["a"].alias("also")).cast(row)).alias("rows")))

    return F.aggregate(F.array_sort(patterns), start, choose, lambda state: state["rows"])


def _world(docs: DataFrame) -> DataFrame:
    """docs with the members of each axis and what excludes a document so far."""
    values = lambda name: F.flatten(F.transform("statements", lambda s: s[name]))
    out = docs.withColumn("action_all", values("action_texts")).withColumn("resource_all", values("resource_texts"))
    for axis in ("action", "resource"):
        fold, all_ = axis == "action", F.col(f"{axis}_all")
        concrete = F.array_sort(F.array_distinct(F.filter(all_, lambda x: ~_wild(x))))
        out = out.withColumn(f"{axis}_concrete", concrete).withColumn(f"{axis}_patterns", _first_spelling(F.filter(all_, _wild), fold))
        members = F.array_append(F.col(f"{axis}_concrete"), F.lit(PROBES[axis]))
        out = out.withColumn(f"{axis}_witnesses", witnesses(F.col(f"{axis}_patterns"), members, axis))
        chosen = F.array_sort(F.transform(F.col(f"{axis}_witnesses"), lambda w: w["witness"]))
        out = out.withColumn(f"{axis}s", F.concat(f"{axis}_concrete", chosen, F.array(F.lit(PROBES[axis]))))
    one = lambda p: F.struct(F.lit(p[0]).alias("type"), F.lit(p[1]).alias("id"))
    people = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("statements", lambda s: F.coalesce(s["people"], F.array()))), lambda p: p["id"] != "*")))
    identity = ~F.exists("statements", lambda s: s["named"])
    star = F.exists("statements", lambda s: s["named"] & (s["who"] == "all"))
    out = out.withColumn("identity", identity).withColumn("principals", F.when(F.col("identity"), F.array(one(CALLER))).otherwise(F.concat(people, F.when(star, F.array(one(ANYONE))).otherwise(F.array()), F.array(one(STRANGER)))))
    kinds = F.create_map(*(F.lit(x) for kv in iam.OPERATORS.items() for x in kv))
    tests = F.flatten(F.transform("statements", lambda s: s["conditions"]))
    out = out.withColumn("tests", tests).withColumn("keys", F.array_sort(F.array_distinct(F.transform("tests", lambda c: F.struct(c["key"].alias("key"), F.element_at(kinds, c["op"]).alias("kind"))))))
    words = lambda k: F.array_append(F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("tests", lambda c: c["key"] == k["key"]), lambda c: F.transform(c["values"], lambda v: v["s"]))))), F.lit(equivalence.UNSEEN))
    out = out.withColumn("words", F.transform(F.filter("keys", lambda k: k["kind"] == "str"), lambda k: F.struct(k["key"].alias("key"), words(k).alias("values"))))

    many = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    odd = lambda c: F.exists(c, lambda x: ~F.regexp_like(x, F.lit("^[A-Za-z0-9_]")))
    ids = lambda c: F.transform(c, safe_id)
    names = [ids(F.col("actions")), ids(F.col("resources")), F.transform("principals", lambda p: safe_id(p["id"]))]
    values_clash = F.exists("words", lambda w: many(ids(w["values"])))
    reason = (
        F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.size("statements") == 0, "no statement")
        .when(~F.col("identity") & F.exists("statements", lambda s: ~s["named"]), "some statements name nobody")
        .when(F.size(F.array_distinct(F.transform("action_concrete", F.lower))) < F.size("action_concrete"), "action case variant")
        .when(F.exists(F.concat("action_witnesses", "resource_witnesses"), lambda w: w["witness"].isNull()), "witness unavailable")
        .when(many(F.transform("keys", lambda k: k["key"])), "condition key of two types")
        .when(odd(names[0]) | odd(names[1]) | odd(names[2]), "unsafe identifier")
        .when(many(names[0]) | many(names[1]) | many(names[2]) | many(F.transform("keys", lambda k: safe_attr(k["key"]))) | values_clash, "identifier collision")
    )
    return out.withColumn("excluded", reason)


def _alternatives(statement: Column) -> Column:
    """What each condition of a statement leaves as alternatives: array<array<array<CONDITION>>>. A negated one is a single conjunction of all its values."""
    op_of = F.create_map(*(F.lit(x) for kv in _TESTS.items() for x in kv))

    def one(c: Column) -> Column:
        own = F.array_sort(F.array_distinct(F.transform(c["values"], lambda v: F.when(v["t"] == "str", v.withField("s", safe_id(v["s"]))).otherwise(v))))
        left = F.struct(F.lit("context").alias("subject"), safe_attr(c["key"]).alias("attr"), F.lit(None).cast(VALUE).alias("value"))
        test = lambda v: F.struct(left.alias("left"), F.element_at(op_of, c["op"]).alias("op"), F.struct(F.lit(None).alias("subject"), F.lit(None).alias("attr"), v.alias("value")).alias("right")).cast(CONDITION)
        every = F.transform(own, test)
        return F.when(c["op"].isin(*iam.NEGATED), F.array(every)).otherwise(F.transform(every, lambda t: F.array(t)))

    return F.transform(statement["conditions"], one)


def _product(parts: Column) -> Column:
    """Every choice of one alternative a part, joined."""
    return F.aggregate(parts, F.array(F.array().cast(f"array<{CONDITION}>")), lambda acc, alts: F.flatten(F.transform(acc, lambda a: F.transform(alts, lambda b: F.concat(a, b)))))


def convert(docs: DataFrame) -> DataFrame:
    """(key, excluded, rules, actions, resources, principals, action_witnesses, resource_witnesses, keys, words, ..) of documents parsed by `iam.statements`.

    excluded says why a document has no rules. The axes hold the document's own strings, the rules their ids; keys and words are its condition keys with their kinds, and the texts of its string keys.
    """
    world = _world(docs)

    def scopes(all_: Column, hit: Column, kind: str, name) -> Column:
        whole = F.struct(F.lit("any").alias("kind"), F.lit(None).alias("entity"), F.lit(None).alias("type")).cast(SCOPE)
        each = F.transform(hit, lambda m: F.struct(F.lit("eq").alias("kind"), F.struct(F.lit(kind).alias("type"), safe_id(name(m)).alias("id")).alias("entity"), F.lit(None).alias("type")).cast(SCOPE))
        return F.when(F.size(hit) == F.size(all_), F.array(whole)).otherwise(each)

    def covered(s: Column, axis: str) -> Column:
        met = lambda m: F.exists(s[f"{axis}_texts"], lambda g: _fits(g, m, axis == "action"))
        return F.filter(F.col(f"{axis}s"), lambda m: F.when(s[f"{axis}_in"], met(m)).otherwise(~met(m)))

    def parts(s: Column, i: Column) -> Column:
        listed = lambda p: F.exists(s["people"], lambda x: (x["type"] == p["type"]) & (x["id"] == p["id"]))
        people = F.filter("principals", lambda p: F.when(s["who"] == "all", True).when(s["who"] == "one of", listed(p)).otherwise(~listed(p)))
        return F.struct(
            i.alias("i"), F.when(s["effect"] == "Allow", "permit").otherwise("forbid").alias("effect"), F.transform(covered(s, "action"), safe_id).alias("actions"),
            scopes(F.col("principals"), people, PRINCIPAL, lambda m: m["id"]).alias("who"), scopes(F.col("resources"), covered(s, "resource"), RESOURCE, lambda m: m).alias("what"), _alternatives(s).alias("when"),
        )

    told = world.withColumn("parts", F.when(F.col("excluded").isNull(), F.transform("statements", parts)))
    told = told.withColumn("parts", F.filter("parts", lambda p: (F.size(p["actions"]) > 0) & (F.size(p["who"]) > 0) & (F.size(p["what"]) > 0)))
    # Counted before anything is multiplied out.
    number = lambda p: F.aggregate(p["when"], (F.size(p["who"]) * F.size(p["what"])).cast("double"), lambda acc, alts: acc * F.size(alts))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + number(p))
    told = told.withColumn("excluded", F.when(F.col("excluded").isNotNull(), F.col("excluded")).when(F.size("parts") == 0, "no statement matches").when(total > MOST_RULES, "too many rules"))

    def rules(p: Column) -> Column:
        each = F.flatten(F.transform(p["who"], lambda w: F.flatten(F.transform(p["what"], lambda r: F.transform(_product(p["when"]), lambda c: F.struct(w.alias("w"), r.alias("r"), c.alias("c")))))))
        name = lambda j: F.concat(F.lit("s"), p["i"].cast("string"), F.when(number(p) > 1, F.concat(F.lit("_"), j.cast("string"))).otherwise(""))
        return F.transform(each, lambda x, j: F.struct(name(j).alias("rule_id"), p["effect"].alias("effect"), x["w"].alias("principal"), p["actions"].alias("actions"), x["r"].alias("resource"), x["c"].alias("conditions")).cast(RULE))

    done = told.withColumn("rules", F.when(F.col("excluded").isNull(), F.flatten(F.transform("parts", rules))))
    kept = written(done.select("key", "excluded", "rules", "actions", "resources", "principals", "action_witnesses", "resource_witnesses", "keys", "words", "statements", "refused"))
    pairs, keys = _as_pairs(kept)
    options = equivalence.context_options(pairs, keys).groupBy(F.col("pair").alias("key")).agg(F.product(F.size("options")).alias("contexts"))
    sized = kept.join(by_merge(options), "key", "left").withColumn("requests", F.size("actions") * F.size("resources") * F.size("principals") * F.coalesce("contexts", F.lit(1.0)))
    large = F.coalesce(F.col("requests") > MOST_REQUESTS, F.lit(False))
    return written(sized.withColumn("excluded", F.coalesce("excluded", F.when(large, "world too large"))).withColumn("rules", F.when(F.col("excluded").isNull(), F.col("rules"))).drop("contexts", "requests"))


def _as_pairs(converted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as pairs of rules and no other rules, and their context keys, as `equivalence` takes them."""
    some = converted.where("excluded is null")
    keys = some.select(F.col("key").alias("policy_id"), F.explode("keys").alias("k")).select("policy_id", safe_attr(F.col("k.key")).alias("attr"), F.col("k.kind").alias("kind"))
    return some.select(F.col("key").alias("pair"), F.col("key").alias("policy_id"), F.col("rules").alias("gold"), F.array().cast(f"array<{RULE}>").alias("given")), keys


def requests(converted: DataFrame) -> DataFrame:
    """Every request of each document's world: policy_id, action, principal, resource and context as `policy.evaluate` takes them, and said (action, resource, principal, context) as `iam.decide` does."""
    some = converted.where("excluded is null")
    pairs, keys = _as_pairs(converted)
    contexts = equivalence.contexts(pairs, keys).select(F.col("pair").alias("key"), "context")
    none = F.map_from_arrays(F.array().cast(_NONE), F.array().cast(f"array<{VALUE}>"))

    def entity(kind: str, name: Column) -> Column:
        key = F.concat(F.lit(f"{kind}::"), safe_id(name))
        return F.struct(key.alias("key"), F.lit(kind).alias("type"), F.array(key).alias("groups"), none.alias("attrs"))

    each = some.select("key", "keys", "words", "resources", "principals", F.explode("actions").alias("a")).select("*", F.explode("resources").alias("r")).select("*", F.explode("principals").alias("p")).drop("resources", "principals").join(by_merge(contexts), "key")
    # Back to the document's own keys and texts.
    own_key = lambda attr: F.get(F.filter("keys", lambda k: safe_attr(k["key"]) == attr), F.lit(0))["key"]
    text = lambda key, s: F.get(F.filter(F.get(F.filter("words", lambda w: w["key"] == key), F.lit(0))["values"], lambda x: safe_id(x) == s), F.lit(0))
    back = F.transform(F.map_entries("context"), lambda e: let(own_key(e["key"]), lambda k: F.struct(k.alias("key"), F.when(e["value"]["t"] == "str", e["value"].withField("s", F.coalesce(text(k, e["value"]["s"]), e["value"]["s"]))).otherwise(e["value"]).alias("value"))))
    said = F.struct(F.col("a").alias("action"), F.col("r").alias("resource"), F.col("p").alias("principal"), F.map_from_entries(back).alias("context"))
    return each.select(F.col("key").alias("policy_id"), safe_id(F.col("a")).alias("action"), entity(PRINCIPAL, F.col("p.id")).alias("principal"), entity(RESOURCE, F.col("r")).alias("resource"), "context", said.alias("said"))


def faithfulness(converted: DataFrame) -> DataFrame:
    """(key, requests, allowed, mismatches, refusals): how many requests of each document's world the rules allow, on how many the document decides otherwise, and how many it refuses to judge."""
    some = converted.where("excluded is null")
    asked = written(requests(some))
    rules = some.select(F.col("key").alias("policy_id"), F.explode("rules").alias("rule"))
    ours = policy.evaluate(asked, rules).select("policy_id", F.col("decision").alias("ours"), "said.*")
    both = iam.decide(ours.withColumnRenamed("policy_id", "key"), by_merge(some.select("key", "refused", "statements")))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("ours") == "allow").alias("allowed"), F.count_if(F.col("refused").isNull() & (F.col("ours") != F.col("decision"))).alias("mismatches"), F.count(F.col("refused")).alias("refusals"))
