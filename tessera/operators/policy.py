"""Policy evaluation as relational plans: membership, scopes, conditions, deny-overrides decisions, owners, checks.

A policy's rules are few against its requests, so they are gathered to one array per (policy, action) and joined to the requests
once; everything after that is decided within the row by higher-order functions. Requests are never shuffled for
evaluation while the rule table is small enough to broadcast, and meet it in one equi-join beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..sources.storage import by_merge, shared_dir

#: Rules up to which the rule table is broadcast (about 1 KB each).
BROADCAST_RULES = 20_000
OPERATORS = ("==", "!=", "<", "<=", ">", ">=")


def closure(parents: DataFrame) -> DataFrame:
    """(policy_id, key, ancestor) of direct (policy_id, key, parent): all that can be reached, itself only on a cycle.

    Round k knows what walks of up to 2^k steps reach, and the ends of walks of just 2^k steps; joined they give walks of up to
    twice as many, so rounds number the logarithm of the depth. They end when a round finds no new pair, which comes about as pairs are
    finite. Each round is checkpointed, so a plan is one round long however deep the membership.
    """
    context = parents.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(parents.sparkSession))
    walks = parents.select("policy_id", "key", F.col("parent").alias("ancestor")).distinct().checkpoint()
    reached, n = walks, walks.count()

    def onward(df: DataFrame) -> DataFrame:
        step = walks.select("policy_id", F.col("key").alias("ancestor"), F.col("ancestor").alias("end"))
        return df.join(step, ["policy_id", "ancestor"]).select("policy_id", "key", F.col("end").alias("ancestor"))

    while True:
        wider = reached.unionAll(onward(reached)).distinct().checkpoint()
        before, n = n, wider.count()
        if n == before:
            return reached
        reached, walks = wider, onward(walks).distinct().checkpoint()


def with_groups(entities: DataFrame, ancestors: DataFrame) -> DataFrame:
    """entities (policy_id, key, ..) with `groups`, the sorted keys of all it is a member of, and itself."""
    found = ancestors.groupBy("policy_id", "key").agg(F.collect_set("ancestor").alias("found"))
    both = entities.join(found, ["policy_id", "key"], "left")
    groups = F.array_sort(F.array_union(F.array("key"), F.coalesce("found", F.array().cast("array<string>"))))
    return both.withColumn("groups", groups).drop("found")


def in_scope(scope: Column, key: Column, kind: Column, groups: Column) -> Column:
    """Whether an entity (key, type, groups with itself) is within a scope."""
    target = F.concat(scope["entity"]["type"], F.lit("::"), scope["entity"]["id"])
    name = scope["kind"]
    return (
        F.when(name == "any", F.lit(True))
        .when(name == "eq", key == target)
        .when(name == "is", kind == scope["type"])
        .when(name == "in", F.array_contains(groups, target))
        .when(name == "is_in", (kind == scope["type"]) & F.array_contains(groups, target))
    )


def resolve(operand: Column, request: dict[str, Column]) -> Column:
    """The value of an operand: its literal, or the attribute of a subject (maps by subject name)."""
    found = operand["value"]
    for subject, values in request.items():
        found = F.when(operand["subject"] == subject, F.element_at(values, operand["attr"])).otherwise(found)
    return found


def compare(left: Column, op: Column, right: Column) -> Column:
    """Tagged comparison; values of different types are unequal, and only integers are ordered."""
    same = (left["t"] == right["t"]) & F.coalesce(left["s"] == right["s"], left["i"] == right["i"], left["b"] == right["b"])
    ints = (left["t"] == "int") & (right["t"] == "int")
    ordered = (
        F.when(op == "<", left["i"] < right["i"]).when(op == "<=", left["i"] <= right["i"])
        .when(op == ">", left["i"] > right["i"]).when(op == ">=", left["i"] >= right["i"])
    )
    return F.when(op == "==", same).when(op == "!=", ~same).otherwise(ints & ordered)


def rules_by_action(rules: DataFrame) -> DataFrame:
    """(policy_id, action, rules): the rules that name each action, in order of rule_id."""
    each = rules.select("policy_id", F.explode(F.array_distinct("rule.actions")).alias("action"), "rule")
    return each.groupBy("policy_id", "action").agg(F.array_sort(F.collect_list("rule"), lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0)).alias("rules"))


def _with_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    grouped = rules_by_action(rules)
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        return requests.join(F.broadcast(grouped), ["policy_id", "action"], "left")
    return requests.join(by_merge(grouped), ["policy_id", "action"], "left")


def evaluate(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Decide each request: decision (allow or deny), permits and forbids (sorted ids of matching rules), governing.

    requests: policy_id, action, principal and resource (struct key, type, groups, attrs map) and context map. A forbid
    overrides, no match denies. governing says what settled it: forbid, permit, condition (only conditions kept a
    permit from matching) or scope.
    """
    joined = _with_rules(requests, rules)
    maps = {"principal": F.col("principal.attrs"), "resource": F.col("resource.attrs"), "context": F.col("context")}

    def scoped(r: Column) -> Column:
        return in_scope(r["principal"], F.col("principal.key"), F.col("principal.type"), F.col("principal.groups")) & in_scope(r["resource"], F.col("resource.key"), F.col("resource.type"), F.col("resource.groups"))

    def holds(r: Column) -> Column:
        test = lambda c: let(resolve(c["left"], maps), lambda a: let(resolve(c["right"], maps), lambda b: compare(a, c["op"], b)))
        return F.forall(r["conditions"], lambda c: F.coalesce(test(c), F.lit(False)))

    none = F.array().cast("array<string>")
    within = joined.withColumn("_scoped", F.filter("rules", scoped)).withColumn("_hit", F.filter("_scoped", holds))
    ids = lambda effect: F.coalesce(F.transform(F.filter("_hit", lambda r: r["effect"] == effect), lambda r: r["rule_id"]), none)
    out = within.withColumn("permits", ids("permit")).withColumn("forbids", ids("forbid"))
    allow = (F.size("permits") > 0) & (F.size("forbids") == 0)
    blocked = F.coalesce(F.exists("_scoped", lambda r: r["effect"] == "permit"), F.lit(False))
    governing = F.when(F.size("forbids") > 0, "forbid").when(F.size("permits") > 0, "permit").when(blocked, "condition").otherwise("scope")
    return out.withColumn("decision", F.when(allow, "allow").otherwise("deny")).withColumn("governing", governing).drop("rules", "_scoped", "_hit")


def owners(decided: DataFrame, by: list[str], principal: Column | None = None) -> DataFrame:
    """(by.., principal): who is allowed in each group of decided requests, one row each."""
    key = F.col("principal.key") if principal is None else principal
    return decided.where("decision = 'allow'").select(*by, key.alias("principal")).distinct()


def owner_sets(decided: DataFrame, by: list[str], principal: Column | None = None) -> DataFrame:
    """(by.., n_owners, digest): how many principals each group of decided requests allows, and an order-free digest of who; an empty set is an answer.

    The digest is the sum of 32 bits of each key's hash, so no group's principals meet in one row.
    """
    key = F.col("principal.key") if principal is None else principal
    each = decided.select(*by, key.alias("_key"), (F.col("decision") == "allow").alias("_ok")).groupBy(*by, "_key").agg(F.max("_ok").alias("_ok"))
    mark = F.conv(F.substring(F.md5("_key"), 1, 8), 16, 10).cast("long")
    return each.groupBy(*by).agg(F.count_if("_ok").alias("n_owners"), F.coalesce(F.sum(F.when(F.col("_ok"), mark)), F.lit(0).cast("long")).alias("digest"))


def tier(rules: DataFrame) -> DataFrame:
    """(policy_id, tier): conditioned where a rule has conditions, else multi_rule or single."""
    each = rules.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("rule.conditions")).alias("c"))
    return each.select("policy_id", F.when(F.col("c") > 0, "conditioned").when(F.col("n") > 1, "multi_rule").otherwise("single").alias("tier"))


def violations(entities: DataFrame, parents: DataFrame, attrs: DataFrame, rules: DataFrame) -> DataFrame:
    """(policy_id, kind, item) of everything that makes a policy ill-formed; empty if all are well-formed.

    entities (policy_id, key, type), parents (policy_id, key, parent), attrs (policy_id, key, type, attr, value_type), rules.
    """
    v = lambda df, kind, item: df.select("policy_id", F.lit(kind).alias("kind"), F.col(item).cast("string").alias("item"))
    known = entities.select("policy_id", F.col("key").alias("known")).distinct()
    twice = entities.groupBy("policy_id", "key").count().where("count > 1")
    orphan = parents.join(known, (parents["policy_id"] == known["policy_id"]) & (parents["parent"] == known["known"]), "left_anti")
    cyclic = closure(parents).where("key = ancestor").select("policy_id", "key").distinct()
    # Every entity of a type must carry the same attributes with the same types.
    shape = entities.join(attrs.groupBy("policy_id", "key").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "attr", "value_type"))), ",").alias("shape")), ["policy_id", "key"], "left")
    mixed = shape.groupBy("policy_id", "type").agg(F.count_distinct(F.coalesce("shape", F.lit(""))).alias("shapes")).where("shapes > 1")
    rule_ids = rules.select("policy_id", F.col("rule.rule_id").alias("rule_id"), "rule")
    repeated = rule_ids.groupBy("policy_id", "rule_id").count().where("count > 1")
    idle = rule_ids.where("coalesce(size(rule.actions), 0) <= 0")
    odd = rule_ids.where(~F.col("rule.effect").isin("permit", "forbid"))
    targets = rule_ids.select("policy_id", F.explode(F.array("rule.principal.entity", "rule.resource.entity")).alias("e")).where("e is not null").select("policy_id", F.concat_ws("::", "e.type", "e.id").alias("target")).distinct()
    lost = targets.join(known, (targets["policy_id"] == known["policy_id"]) & (targets["target"] == known["known"]), "left_anti")
    wrong = rule_ids.where(F.exists("rule.conditions", lambda c: ~c["op"].isin(*OPERATORS) | c["op"].isin("<", "<=", ">", ">=") & ((c["left"]["value"]["t"] != "int") | (c["right"]["value"]["t"] != "int"))))
    parts = [v(twice, "repeated entity", "key"), v(orphan, "unknown parent", "parent"), v(cyclic, "cyclic membership", "key"), v(mixed, "mixed attributes", "type"), v(repeated, "repeated rule", "rule_id"), v(idle, "no action", "rule_id"), v(odd, "unknown effect", "rule_id"), v(lost, "unknown scope target", "target"), v(wrong, "ill-typed condition", "rule_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def boundary(decided: DataFrame, by: list[str], axes: list[str], decision: str = "decision") -> DataFrame:
    """Add `boundary`: whether changing one coordinate alone flips the decision, for requests that form a full cross product.

    A flip along an axis exists iff decisions differ among the requests that agree on all other coordinates, so each axis
    is one aggregate in a window over the others instead of a join of neighbours.
    """
    flips = []
    for axis in axes:
        w = Window.partitionBy(*by, *(a for a in axes if a != axis))
        flips.append(F.min(decision).over(w) != F.max(decision).over(w))
    any_flip = flips[0]
    for f in flips[1:]:
        any_flip = any_flip | f
    return decided.withColumn("boundary", any_flip)


def rotation(keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by.., key, renamed): each id takes the next one's name, the last the first's.

    Keys are put in ranges first, so that a group is sorted in as many tasks as it fills; the last of a range takes the first of the next one.
    """
    ranged = keys.select(*by, key).distinct().repartitionByRange(*by, key).withColumn("_range", F.spark_partition_id())
    shared_dir(keys.sparkSession)
    ranged = ranged.checkpoint()  # ranges come from a sample: written out, or a lost task could draw others
    heads = ranged.groupBy(*by, "_range").agg(F.min(key).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_range")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_next", F.coalesce(F.lead("_first").over(w), F.first("_first").over(whole))).drop("_first")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*by, "_range")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    within = ranged.withColumn("_after", F.lead(key).over(Window.partitionBy(*by, "_range").orderBy(key)))
    return within.alias("k").join(heads.alias("h"), on).select(*(F.col(f"k.{c}") for c in (*by, key)), F.coalesce("_after", "_next").alias("renamed"))


def balanced_sample(rows: DataFrame, by: list[str], label: str, boundary_flag: str, order: Column, n: int) -> DataFrame:
    """At most n rows of each label within each group, those on the boundary first, then in the given order."""
    w = Window.partitionBy(*by, label).orderBy(F.col(boundary_flag).desc(), order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_per_key(rows: DataFrame, key: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def context_values(conditions: DataFrame, keys: DataFrame) -> DataFrame:
    """(policy_id, key, kind, options): values a context key must take so that every comparison in the rules can fall either way.

    conditions (policy_id, key, literal struct), keys (policy_id, key, kind). Integers bring their neighbours, booleans both
    values, strings one unseen word; an integer key without literals is tried at 0.
    """
    seen = conditions.groupBy("policy_id", "key").agg(F.collect_set("literal.i").alias("ints"), F.collect_set("literal.s").alias("words"))
    both = keys.join(seen, ["policy_id", "key"], "left")
    none_i, none_s = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    near = F.flatten(F.transform(F.coalesce("ints", none_i), lambda x: F.array(x - 1, x, x + 1)))
    ints = F.when(F.size(near) > 0, near).otherwise(F.array(F.lit(0).cast("bigint")))
    words = F.array_append(F.coalesce("words", none_s), F.lit("~other"))
    options = F.when(F.col("kind") == "int", F.transform(F.array_sort(F.array_distinct(ints)), lambda x: x.cast("string"))).when(F.col("kind") == "bool", F.array(F.lit("false"), F.lit("true"))).otherwise(F.array_sort(F.array_distinct(words)))
    return both.select("policy_id", "key", "kind", options.alias("options"))


def rename_rules(rules: DataFrame, names: DataFrame) -> DataFrame:
    """Rules with the entities of their scopes renamed by (policy_id, type, id, renamed); entities without a new name keep theirs.

    A policy's names are gathered to one map, so a rule is renamed within its row.
    """
    maps = names.groupBy("policy_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("::", "type", "id"), "renamed"))).alias("_names"))
    both = rules.join(maps, "policy_id", "left")

    def renamed(scope: Column) -> Column:
        entity = scope["entity"]
        new = F.coalesce(F.element_at("_names", F.concat_ws("::", entity["type"], entity["id"])), entity["id"])
        moved = F.when(entity.isNotNull(), F.struct(entity["type"].alias("type"), new.alias("id")))
        return F.struct(scope["kind"].alias("kind"), moved.alias("entity"), scope["type"].alias("type"))

    r = F.col("rule")
    changed = F.struct(r["rule_id"].alias("rule_id"), r["effect"].alias("effect"), renamed(r["principal"]).alias("principal"), r["actions"].alias("actions"), renamed(r["resource"]).alias("resource"), r["conditions"].alias("conditions"))
    return both.select("policy_id", changed.alias("rule"))


def universe(principals: DataFrame, actions: DataFrame, resources: DataFrame, contexts: DataFrame, limit: int = 200_000) -> DataFrame:
    """Every request of each policy: the product of its principals, actions, resources and contexts within the policy.

    The size is counted first, and a policy beyond `limit` requests is refused: a closed universe is small by nature.
    """
    sizes = None
    for df in (principals, actions, resources, contexts):
        n = df.groupBy("policy_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
        sizes = n if sizes is None else sizes.join(n.withColumnRenamed("n", "m"), "policy_id").select("policy_id", (F.col("n") * F.col("m")).alias("n"))
    if not sizes.where(F.col("n") > limit).isEmpty():
        raise ValueError(f"a policy has a universe of more than {limit} requests")
    return principals.join(actions, "policy_id").join(resources, "policy_id").join(contexts, "policy_id")


def decisive_rules(decided: DataFrame) -> DataFrame:
    """(policy_id, rule_id, n): on how many requests each rule alone makes the decision; rules that are absent are dead.

    A rule is decisive where taking it out would flip the decision: the only permit of an allowed request, or the only forbid of
    one that is permitted otherwise. So one pass over decided requests stands for evaluating without each rule in turn.
    """
    alone = F.when((F.col("decision") == "allow") & (F.size("permits") == 1), F.get("permits", F.lit(0))).when((F.size("permits") > 0) & (F.size("forbids") == 1), F.get("forbids", F.lit(0)))
    return decided.select("policy_id", alone.alias("rule_id")).where("rule_id is not null").groupBy("policy_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def conflicts(decided: DataFrame) -> DataFrame:
    """(policy_id, permit, forbid, n): pairs of rules that meet on a request, and how often."""
    met = decided.where("size(permits) > 0 and size(forbids) > 0").select("policy_id", F.explode("permits").alias("permit"), "forbids")
    return met.select("policy_id", "permit", F.explode("forbids").alias("forbid")).groupBy("policy_id", "permit", "forbid").agg(F.count(F.lit(1)).alias("n"))
