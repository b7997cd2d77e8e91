"""What a rule set read from an answer says, against what it should say, over the closed universe of both.

The literals of both rule sets make one universe of requests: principals x actions x resources x contexts of a policy. It is never spelled out. A member of
an axis is described by a bitmask of the rules of both sides that it leaves standing (scope and the conditions that read it alone), and members of equal masks
decide alike, so requests are cells of equal masks with a count and a least number. A cell's masks are ANDed. Conditions that read two axes are
tested where a pair has any; there, members are told apart by where their values lie among those they are compared with, not by the values, so that
cells grow with the smaller side. Readings of a policy that say the same are scored once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.policy_text import normal_form
from ..schemas import VALUE
from ..sources.storage import by_merge, written
from .policy import compare, in_scope, resolve

UNSEEN = "__unseen__"
_ORDERED = ("<", "<=", ">", ">=")


def _subjects(c: Column) -> Column:
    return F.array_distinct(F.filter(F.array(c["left"]["subject"], c["right"]["subject"]), lambda s: s.isNotNull()))


def _reads_only(c: Column, subject: str) -> Column:
    return F.forall(_subjects(c), lambda s: s == subject)


def classes(gold: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings with `pair`, pairs): pairs (pair, policy_id, gold, given, exact) of the different things that readings of each policy say, written.

    gold (policy_id, rules), readings (policy_id, .., rules), rules as arrays; a reading without rules (null) has no pair.
    """
    said = F.sha2(F.concat_ws("\n", "policy_id", F.array_join(normal_form(F.col("rules")), "\n")), 256)
    named = written(readings.withColumn("pair", F.when(F.col("rules").isNotNull(), said)))
    some = named.where("pair is not null").groupBy("pair", "policy_id").agg(F.any_value("rules").alias("given"))
    both = some.join(gold.select("policy_id", F.col("rules").alias("gold"), said.alias("whole")), "policy_id")
    return named, written(both.select("pair", "policy_id", "gold", "given", (F.col("whole") == F.col("pair")).alias("exact")))


def rule_problems(pairs: DataFrame, entities: DataFrame, attrs: DataFrame, actions: DataFrame, context: DataFrame) -> DataFrame:
    """(pair, place, problem): what is wrong with the given rules of each pair, at the place of the rule (from 0); none for rule sets that are well-formed.

    entities (policy_id, key, type, groups), attrs (policy_id, type, attr, kind), actions (policy_id, action), context (policy_id, attr, kind). An empty rule set is well-formed.
    """
    rules = pairs.select("pair", "policy_id", F.posexplode("given").alias("place", "rule"))
    known = by_merge(entities.select("policy_id", "key", F.lit(True).alias("known")))
    types = entities.select("policy_id", "type").distinct()
    found = lambda df, problem: df.select("pair", "place", F.lit(problem).alias("problem"))
    acts = rules.select("pair", "policy_id", "place", F.explode("rule.actions").alias("action")).join(actions, ["policy_id", "action"], "left_anti")
    idle = rules.where("coalesce(size(rule.actions), 0) <= 0")
    scopes = rules.select("pair", "policy_id", "place", F.explode(F.array(*(F.struct(F.lit(s).alias("subject"), F.col(f"rule.{s}").alias("s")) for s in ("principal", "resource")))).alias("x")).select("pair", "policy_id", "place", "x.subject", "x.s")
    target = F.concat_ws("::", "s.entity.type", "s.entity.id")
    lost = scopes.where("s.kind in ('eq', 'in', 'is_in')").select("*", target.alias("key")).join(known, ["policy_id", "key"], "left_anti")
    odd = scopes.where("s.kind in ('is', 'is_in')").select("*", F.col("s.type").alias("type")).join(types, ["policy_id", "type"], "left_anti")

    every = scopes.where("s.kind = 'any'").join(types, "policy_id").select("pair", "policy_id", "place", "subject", "type")
    stated = scopes.where("s.kind in ('is', 'is_in', 'eq')").select("pair", "policy_id", "place", "subject", F.coalesce("s.type", "s.entity.type").alias("type"))
    members = by_merge(entities.select("policy_id", "type", F.explode("groups").alias("key")).distinct())
    within = scopes.where("s.kind = 'in'").select("*", target.alias("key")).join(members, ["policy_id", "key"]).select("pair", "policy_id", "place", "subject", "type")
    reach = every.unionAll(stated).unionAll(within).distinct()

    tests = rules.select("pair", "policy_id", "place", F.posexplode("rule.conditions").alias("at", "c"))
    sides = tests.select("pair", "policy_id", "place", "at", F.explode(F.array("c.left", "c.right")).alias("o"))
    refs = sides.where("o.subject is not null").select("pair", "policy_id", "place", "at", "o.subject", "o.attr")
    of_context = refs.where("subject = 'context'").join(context, ["policy_id", "attr"], "left").select("pair", "place", "at", "kind")
    of_entities = refs.where("subject != 'context'").join(reach, ["pair", "policy_id", "place", "subject"]).join(attrs, ["policy_id", "type", "attr"], "left").select("pair", "place", "at", "kind")
    literals = sides.where("o.value is not null").select("pair", "place", "at", F.col("o.value.t").alias("kind"))
    kinds = of_context.unionAll(of_entities).unionAll(literals).groupBy("pair", "place", "at").agg(F.count_if(F.col("kind").isNull()).alias("lacking"), F.count_distinct("kind").alias("kinds"), F.max("kind").alias("kind"))
    judged = kinds.join(tests.select("pair", "place", "at", F.col("c.op").alias("op")), ["pair", "place", "at"])
    wrong = F.when(F.col("lacking") > 0, "unknown attribute").when(F.col("kinds") != 1, "mismatched types").when(F.col("op").isin(*_ORDERED) & (F.col("kind") != "int"), "ordered without integers")
    typed = judged.select("pair", "place", wrong.alias("problem")).where("problem is not null")
    parts = [found(acts, "unknown action"), found(idle, "no action"), found(lost, "unknown entity"), found(odd, "unknown type"), typed]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def context_options(pairs: DataFrame, context: DataFrame) -> DataFrame:
    """(pair, attr, options): the tagged values that a context key takes so that every comparison of either side can fall both ways.

    Integers bring their neighbours (0 where none is compared), booleans both values, strings one unseen word; in order of value.
    """
    sides = pairs.select("pair", F.explode(F.flatten(F.transform(F.concat("gold", "given"), lambda r: r["conditions"]))).alias("c"))
    each = sides.select("pair", F.explode(F.array(F.struct(F.col("c.left").alias("x"), F.col("c.right").alias("y")), F.struct(F.col("c.right").alias("x"), F.col("c.left").alias("y")))).alias("s"))
    seen = each.where("s.x.subject = 'context' and s.y.value is not null").groupBy("pair", F.col("s.x.attr").alias("attr")).agg(F.collect_set("s.y.value.i").alias("ints"), F.collect_set("s.y.value.s").alias("words"))
    keys = pairs.select("pair", "policy_id").join(by_merge(context), "policy_id").select("pair", "attr", "kind")
    both = keys.join(by_merge(seen), ["pair", "attr"], "left")
    none = lambda t: F.lit(None).cast(t)
    value = lambda t, s, i, b: F.struct(F.lit(t).alias("t"), s.cast("string").alias("s"), i.cast("bigint").alias("i"), b.cast("boolean").alias("b")).cast(VALUE)
    near = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("ints", F.array().cast("array<bigint>")), lambda x: F.array(x - 1, x, x + 1)))))
    near = F.when(F.size(near) > 0, near).otherwise(F.array(F.lit(0).cast("bigint")))
    words = F.array_append(F.array_sort(F.coalesce("words", F.array().cast("array<string>"))), F.lit(UNSEEN))
    options = (
        F.when(F.col("kind") == "int", F.transform(near, lambda x: value("int", none("string"), x, none("boolean"))))
        .when(F.col("kind") == "bool", F.transform(F.array(F.lit(False), F.lit(True)), lambda x: value("bool", none("string"), none("bigint"), x)))
        .otherwise(F.transform(words, lambda x: value("str", x, none("bigint"), none("boolean"))))
    )
    return both.select("pair", "attr", options.alias("options"))


def contexts(pairs: DataFrame, context: DataFrame) -> DataFrame:
    """(pair, n, context): every combination of the options, numbered with the last key (in order of name) running fastest."""
    keys = context_options(pairs, context).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("attr", "options")), lambda a, b: F.when(a["attr"] < b["attr"], -1).otherwise(1)).alias("keys"))
    both = pairs.select("pair").join(by_merge(keys), "pair", "left").withColumn("keys", F.coalesce("keys", F.array().cast(f"array<struct<attr:string,options:array<{VALUE}>>>")))
    # Steps of the mixed radix: the product of the sizes of the keys after each.
    total = lambda ks: F.aggregate(ks, F.lit(1).cast("bigint"), lambda acc, k: acc * F.size(k["options"]))
    all_ = both.withColumn("total", total(F.col("keys"))).withColumn("steps", F.transform("keys", lambda k, i: total(F.slice("keys", i + 2, F.size("keys")))))
    each = all_.withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)))
    pick = F.transform(F.arrays_zip("keys", "steps"), lambda z: F.struct(z["keys"]["attr"].alias("k"), F.get(z["keys"]["options"], (F.floor(F.col("n") / z["steps"]) % F.size(z["keys"]["options"])).cast("int")).alias("v")))
    return each.select("pair", "n", F.map_from_entries(pick).alias("context"))


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))


def _bits(where: Column, words: int) -> Column:
    """An aggregate: the mask of the slots for which `where` holds."""
    word = lambda w: F.coalesce(F.bit_or(F.when(where & (F.floor(F.col("slot") / 64) == w), _bit(F.col("slot")))), F.lit(0).cast("bigint"))
    return F.array(*map(word, range(words)))


def _crossing(c: Column) -> Column:
    return (c["left"]["subject"] != c["right"]["subject"]) & c["right"]["subject"].isNotNull()


def _holds_alone(rule: Column, subject: str, values: Column) -> Column:
    """Whether all conditions of a rule that read this subject alone hold."""
    own = F.filter(rule["conditions"], lambda c: ~F.coalesce(_crossing(c), F.lit(False)) & (c["left"]["subject"] == subject))
    return F.forall(own, lambda c: F.coalesce(compare(resolve(c["left"], {subject: values}), c["op"], resolve(c["right"], {subject: values})), F.lit(False)))


def _key(subject: Column, attr: Column) -> Column:
    return F.concat(subject, F.lit("."), attr)


def _with_codes(axes: dict[str, tuple[DataFrame, list[str]]], crossings: DataFrame) -> dict[str, DataFrame]:
    """Axes (policy_id, values, ..) with codes: array<struct<own, other, code>>; members of one code compare alike with whatever stands on the other side.

    axes: members with the columns that tell them apart. crossings: distinct (policy_id, subject, attr, other), operands that conditions compare with those of
    another axis; own and other are written subject.attr. A code is a type, and counts the other side's values below and says whether the value is one of them.
    """
    own = {a: crossings.where(F.col("subject") == a).join(df, "policy_id").select(*ids, _key(F.col("subject"), F.col("attr")).alias("own"), "other", F.element_at("values", F.col("attr")).alias("v")) for a, (df, ids) in axes.items()}
    values = reduce(DataFrame.unionAll, (df.select("policy_id", "own", "v").where("v is not null").distinct() for df in own.values()))
    values = written(values)
    sides = crossings.select("policy_id", _key(F.col("subject"), F.col("attr")).alias("own"), "other")
    mine, theirs = sides.join(values, ["policy_id", "own"]).withColumn("met", F.lit(0)), sides.join(values.withColumnRenamed("own", "other"), ["policy_id", "other"]).withColumn("met", F.lit(1))
    each = mine.unionByName(theirs).groupBy("policy_id", "own", "other", "v").agg(F.max("met").alias("met"))
    below = F.coalesce(F.sum("met").over(Window.partitionBy("policy_id", "own", "other").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # What lacks its type or its value equals nothing, and is a code of its own.
    odd = F.col("v.t").isNull() | F.coalesce("v.s", F.col("v.i").cast("string"), F.col("v.b").cast("string")).isNull()
    codes = written(each.select("policy_id", "own", "other", F.to_json("v").alias("k"), F.when(odd, F.to_json("v")).otherwise(F.concat_ws(" ", "v.t", 2 * below + F.col("met"))).alias("code")))
    row = "struct<own:string,other:string,code:string>"

    def coded(df: DataFrame, ids: list[str], own: DataFrame) -> DataFrame:
        met = own.withColumn("k", F.to_json("v")).join(by_merge(codes), ["policy_id", "own", "other", "k"], "left")
        lists = met.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("own", "other", "code").cast(row))).alias("codes"))
        return df.join(by_merge(lists), ids, "left").withColumn("codes", F.coalesce("codes", F.array().cast(f"array<{row}>")))

    return {a: coded(df, ids, own[a]) for a, (df, ids) in axes.items()}


def _cells(slots: DataFrame, members: DataFrame, by: list[str], axis: str, stands: Column, words: int) -> DataFrame:
    """Members of an axis as cells (pair, {axis}_mask, _codes, _n, _count, _values): members of one mask are one cell, unless a condition that reads them beside another axis tells them apart."""
    apart = F.array_contains("apart", axis)
    read = F.filter("codes", lambda c: F.array_contains("crossed", F.concat(c["own"], F.lit(" "), c["other"])))
    masks = slots.join(by_merge(members), by).groupBy("pair", "n").agg(_bits(F.coalesce(stands, F.lit(False)), words).alias("mask"), F.any_value(F.when(apart, F.struct("values", read.alias("codes")))).alias("x"))
    cells = masks.groupBy("pair", "mask", "x.codes").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("count"), F.any_value("x.values").alias("values"))
    return cells.select("pair", *(F.col(c).alias(f"{axis}_{c}") for c in ("mask", "codes", "n", "count", "values")))


def disagreements(pairs: DataFrame, principals: DataFrame, actions: DataFrame, resources: DataFrame, context: DataFrame) -> DataFrame:
    """(pair, requests, differ, over, under, principal, action, resource, context): how many requests of the universe the two rule sets of a pair decide
    differently, of them those allowed by the given one only (over) and by the gold one only (under), and the first request that differs, nulls if none does.

    pairs: see `classes`. principals and resources (policy_id, key, type, groups, attrs), actions (policy_id, action), context (policy_id, attr, kind).
    First: in order of principal, action, resource and context, these by name and by their values.
    """
    order = lambda df, key: df.withColumn("n", F.row_number().over(Window.partitionBy("policy_id").orderBy(key)).cast("bigint") - 1)
    who, acts, what = order(principals, "key"), order(actions.distinct(), "action"), order(resources, "key")
    when = written(contexts(pairs, context))

    blocks = lambda c: F.ceil(F.size(c) / 64)
    words = pairs.agg(F.max(blocks("gold") + blocks("given"))).first()[0] or 1
    sides = F.concat(F.transform("gold", lambda r, i: F.struct(i.cast("bigint").alias("slot"), F.lit(True).alias("of_gold"), r.alias("rule"))), F.transform("given", lambda r, i: F.struct((64 * blocks("gold") + i).cast("bigint").alias("slot"), F.lit(False).alias("of_gold"), r.alias("rule"))))
    across = lambda s: F.filter(s["rule"]["conditions"], lambda c: F.coalesce(_crossing(c), F.lit(False)))
    opened = F.filter(F.transform("sides", lambda s: F.struct(s["slot"].alias("slot"), across(s).alias("tests"))), lambda o: F.size(o["tests"]) > 0)
    tests = F.array_distinct(F.flatten(F.transform("open", lambda o: F.transform(o["tests"], lambda c: F.struct(c["left"]["subject"].alias("a"), c["left"]["attr"].alias("x"), c["right"]["subject"].alias("b"), c["right"]["attr"].alias("y"))))))
    both_ways = F.flatten(F.transform("crossings", lambda t: F.array(F.struct(t["a"].alias("subject"), t["x"].alias("attr"), _key(t["b"], t["y"]).alias("other")), F.struct(t["b"].alias("subject"), t["y"].alias("attr"), _key(t["a"], t["x"]).alias("other")))))
    crossed = F.transform("ways", lambda w: F.concat(_key(w["subject"], w["attr"]), F.lit(" "), w["other"]))
    whole = written(pairs.withColumn("sides", sides).withColumn("open", opened).withColumn("crossings", tests).withColumn("ways", F.array_distinct(both_ways)).withColumn("crossed", crossed).withColumn("apart", F.array_distinct(F.transform("ways", lambda w: w["subject"]))).drop("gold", "given", "crossings"))
    slots = written(whole.select("pair", "policy_id", "apart", "crossed", F.explode_outer("sides").alias("s")).select("pair", "policy_id", "apart", "crossed", "s.slot", "s.of_gold", "s.rule"))
    is_ = lambda gold, effect: F.coalesce((F.col("of_gold") == gold) & (F.col("rule.effect") == effect), F.lit(False))
    effects = slots.groupBy("pair").agg(_bits(is_(True, "permit"), words).alias("gold_permits"), _bits(is_(True, "forbid"), words).alias("gold_forbids"), _bits(is_(False, "permit"), words).alias("permits"), _bits(is_(False, "forbid"), words).alias("forbids"))

    none = F.lit(None).cast(f"map<string,{VALUE}>")
    ids = ["policy_id", "n"]
    axes = {
        "principal": (who.withColumnRenamed("attrs", "values"), ids), "action": (acts.withColumn("values", none), ids), "resource": (what.withColumnRenamed("attrs", "values"), ids),
        "context": (when.join(pairs.select("pair", "policy_id"), "pair").withColumnRenamed("context", "values"), ["policy_id", "pair", "n"]),
    }
    coded = _with_codes(axes, written(whole.select("policy_id", F.inline("ways")).distinct()))

    r = F.col("rule")
    within = lambda side: in_scope(r[side], F.col("key"), F.col("type"), F.col("groups")) & _holds_alone(r, side, F.col("values"))
    stands = {"principal": within("principal"), "action": F.array_contains(r["actions"], F.col("action")), "resource": within("resource"), "context": _holds_alone(r, "context", F.col("values"))}
    cells = {x: written(_cells(slots, coded[x], ["policy_id", "pair"] if x == "context" else ["policy_id"], x, stands[x], words)) for x in axes}
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))
    tests = whole.select("pair", "open")

    def tested(hit: Column, subjects: tuple[str, ...], late: bool) -> Column:
        """A mask without the rules of which a test of two subjects fails; late: a test that reads the context."""
        values = {n: F.col(f"{n}_values") for n in subjects}
        now = lambda o: F.filter(o["tests"], lambda c: ((c["left"]["subject"] == "context") | (c["right"]["subject"] == "context")) == late)

        def one(mask: Column, o: Column) -> Column:
            holds = F.forall(now(o), lambda c: F.coalesce(compare(resolve(c["left"], values), c["op"], resolve(c["right"], values)), F.lit(False)))
            return F.when(holds, mask).otherwise(F.transform(mask, lambda w, i: F.when(i == F.floor(o["slot"] / 64), w.bitwiseAND(F.bitwise_not(_bit(o["slot"])))).otherwise(w)))

        return F.aggregate("open", hit, one)

    # Principals and resources first: what they leave standing is a few masks, unless the context tells them apart too. What is to be multiplied out is small, and would be left in one task.
    spread = cells["principal"].join(tests, "pair").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair", "principal_n")
    met = spread.join(cells["resource"], "pair")
    # Codes and values that only principals and resources are compared by have served.
    left = lambda x: F.filter(f"{x}_codes", lambda c: c["other"].startswith("context."))
    masks = met.select("pair", F.inline(F.array(F.struct(tested(both(F.col("principal_mask"), F.col("resource_mask")), ("principal", "resource"), False).alias("mask")))), left("principal").alias("pc"), left("resource").alias("rc"), F.struct("principal_n", "resource_n").alias("n"), (F.col("principal_count") * F.col("resource_count")).alias("count"), "principal_values", "resource_values")
    some_of = lambda x: F.any_value(F.col(f"{x}_values")).alias(f"{x}_values")
    joint = written(masks.groupBy("pair", "mask", "pc", "rc").agg(F.min("n").alias("n"), F.sum("count").alias("count"), some_of("principal"), some_of("resource")))

    all_ = effects.join(tests, "pair").join(joint, "pair").join(cells["action"], "pair").join(cells["context"], "pair")
    hit = both(both(F.col("mask"), F.col("action_mask")), F.col("context_mask"))
    some = lambda mask, h: F.exists(both(h, F.col(mask)), lambda x: x != 0)
    verdict = lambda h: F.struct((some("gold_permits", h) & ~some("gold_forbids", h)).alias("want"), (some("permits", h) & ~some("forbids", h)).alias("got"))
    n = F.col("count") * F.col("action_count") * F.col("context_count")
    # In order: the least principal of a cell, and the least resource beside it.
    at = F.struct(F.col("n.principal_n").alias("principal_n"), "action_n", F.col("n.resource_n").alias("resource_n"), "context_n")
    # A generator, or each use below would work the verdict out anew.
    all_ = all_.select("pair", n.alias("n"), at.alias("cell"), F.inline(F.array(let(tested(hit, ("principal", "resource", "context"), True), verdict))))
    n, at = F.col("n"), F.col("cell")
    names = ("principal", "action", "resource", "context")
    counted = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("bigint"))
    over, under = F.col("got") & ~F.col("want"), F.col("want") & ~F.col("got")
    found = all_.groupBy("pair").agg(F.sum(n).alias("requests"), counted(over | under).alias("differ"), counted(over).alias("over"), counted(under).alias("under"), F.min(F.when(over | under, at)).alias("at"))

    shown = found.join(pairs.select("pair", "policy_id"), "pair").select("*", *(F.col(f"at.{x}_n").alias(f"{x}_n") for x in names))
    for name, df, key in (("principal", who, "key"), ("action", acts, "action"), ("resource", what, "key")):
        shown = shown.join(by_merge(df.select("policy_id", F.col("n").alias(f"{name}_n"), F.col(key).alias(name))), ["policy_id", f"{name}_n"], "left")
    text = lambda v: F.coalesce(v["s"], v["i"].cast("string"), v["b"].cast("string"))
    spelled = F.array_join(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), text(e["value"]))), ",")
    shown = shown.join(when.select("pair", F.col("n").alias("context_n"), spelled.alias("context")), ["pair", "context_n"], "left")
    return shown.select("pair", "requests", "differ", "over", "under", *names)


def score_readings(gold: DataFrame, readings: DataFrame, entities: DataFrame, attrs: DataFrame, actions: DataFrame, context: DataFrame, principal_types: list[str], resource_types: list[str]) -> DataFrame:
    """readings (policy_id, .., rules) with valid, problem (of the first rule that has one), exact, equivalent, requests, differ, over, under and the first request that differs.

    entities (policy_id, key, type, groups with itself, attrs map), attrs (policy_id, type, attr, kind). What holds no rules (null) is not
    valid and has no problem; what is not valid is neither exact nor equivalent and is not compared. No rules at all (an empty array) deny everything.
    """
    named, pairs = classes(gold, readings)
    first = rule_problems(pairs, entities, attrs, actions, context).groupBy("pair").agg(F.min(F.struct("place", "problem"))["problem"].alias("problem"))
    judged = written(pairs.join(first, "pair", "left"))
    sound = judged.where("problem is null").drop("problem")
    of = lambda types: entities.where(F.col("type").isin(*types))
    found = disagreements(sound, of(principal_types), actions, of(resource_types), context)
    scored = judged.select("pair", "problem", "exact").join(found, "pair", "left")
    both = named.join(scored, "pair", "left")
    valid = F.col("pair").isNotNull() & F.col("problem").isNull()
    return both.withColumn("valid", valid).withColumn("exact", valid & F.col("exact")).withColumn("equivalent", valid & F.coalesce(F.col("differ") == 0, F.lit(False))).drop("pair")
