"""Audits of designs and runs: what is broken, as rows; an empty result is a pass."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched_groups(rows: DataFrame, group: str, condition: str, required: list[str], fixed: dict[str, Column]) -> DataFrame:
    """(group, problem, item): groups that lack a required condition, have one more than once, or in which something varies that should be fixed.

    A group is judged from counts of its conditions, of which a design has few, however many rows it has.
    """
    cells = rows.groupBy(group, condition).agg(F.count(F.lit(1)).alias("n"), *(F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count(c).alias("k")).alias(f"_{n}") for n, c in fixed.items()))
    whole = cells.groupBy(group).agg(
        F.collect_set(condition).alias("seen"), F.collect_set(F.when(F.col("n") > 1, F.col(condition))).alias("twice"),
        *(((F.min(f"_{n}.a") != F.max(f"_{n}.b")) | (F.sum(f"_{n}.k") != F.sum("n")) & (F.sum(f"_{n}.k") > 0)).alias(f"_{n}") for n in fixed),
    )
    problem = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("problem"), x.alias("item")))
    missing = F.array_except(F.array(*map(F.lit, required)), "seen")
    varied = F.array_compact(F.array(*(F.when(F.col(f"_{n}"), F.lit(n)) for n in fixed)) if fixed else F.array().cast("array<string>"))
    found = F.concat(problem("missing", missing), problem("repeated", F.col("twice")), problem("varies", varied))
    return whole.select(group, F.explode(found).alias("x")).select(group, "x.problem", "x.item")


def role_swaps(rows: DataFrame, pair: str, role: str, first: str, second: str, same: list[str], swapped: tuple[str, str]) -> DataFrame:
    """(pair, problem): pairs of two conditions that should say the same in swapped places: what is in one column of the first is in the other of the second."""
    at = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    a, b = swapped
    cells = rows.groupBy(pair).agg(F.count_if(F.col(role) == first).alias("n1"), F.count_if(F.col(role) == second).alias("n2"), *(at(r, c).alias(f"{c}_{i}") for c in (*same, a, b) for i, r in ((1, first), (2, second))))
    differ = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    kept = F.lit(False)
    for c in same:
        kept = kept | differ(f"{c}_1", f"{c}_2")
    problem = F.when((F.col("n1") != 1) | (F.col("n2") != 1), "missing role").when(kept, "content differs").when(differ(f"{a}_1", f"{b}_2") | differ(f"{b}_1", f"{a}_2"), "places not swapped")
    return cells.select(pair, problem.alias("problem")).where("problem is not null")


def unique_ids(rows: DataFrame, key: str, kind: str, known: list[str]) -> DataFrame:
    """(key, problem): ids that occur twice, and rows of an unknown kind."""
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max((~F.coalesce(F.col(kind).isin(*known), F.lit(False))).cast("int")).alias("odd"))
    return each.select(key, F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "repeated"), F.when(F.col("odd") == 1, "unknown kind")))).alias("problem"))


def independence(rows: DataFrame, columns: list[str], tolerance: float) -> DataFrame:
    """(a, b, r, passed) for each pair of columns: Pearson's correlation, 0 where either is constant, and whether it is within the tolerance."""
    pairs = list(combinations(columns, 2))
    one = rows.agg(*(F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs))
    each = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*")
    return each.withColumn("passed", F.abs("r") < tolerance)


def balance(rows: DataFrame, by: list[str], sides: dict[str, Column]) -> DataFrame:
    """(by.., n, a count for each side, balanced): whether the sides named come out equal within every group."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in sides.items()))
    names = list(sides)
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.col(n) == F.col(names[0]))
    return counts.withColumn("balanced", same)


def swap_axis(principals: DataFrame, resources: DataFrame, world: str) -> DataFrame:
    """(world, axis): which names a second naming should exchange: principals if there are two, else resources, null (not possible) if neither."""
    n = lambda df, c: df.groupBy(world).agg(F.count(F.lit(1)).alias(c))
    both = n(principals, "p").join(n(resources, "r"), world, "full_outer")
    return both.select(world, F.when(F.coalesce("p", F.lit(0)) >= 2, "principals").when(F.coalesce("r", F.lit(0)) >= 2, "resources").alias("axis"))


def scope_types(rules: DataFrame, entities: DataFrame, ancestors: DataFrame, side: str) -> DataFrame:
    """(policy_id, rule_id, type): the entity types that a rule's scope on one side can reach. ancestors: see policy.closure."""
    own = rules.select("policy_id", F.col("rule.rule_id").alias("rule_id"), F.col(f"rule.{side}").alias("s"))
    target = F.concat_ws("::", "s.entity.type", "s.entity.id")
    every = own.where("s.kind = 'any'").join(entities.select("policy_id", "type").distinct(), "policy_id").select("policy_id", "rule_id", "type")
    stated = own.where("s.kind in ('is', 'is_in')").select("policy_id", "rule_id", F.col("s.type").alias("type"))
    one = own.where("s.kind in ('eq', 'in')").select("policy_id", "rule_id", F.col("s.entity.type").alias("type"))
    members = ancestors.select("policy_id", "key", F.col("ancestor").alias("target")).join(entities.select("policy_id", "key", "type"), ["policy_id", "key"]).select("policy_id", "target", "type").distinct()
    within = own.where("s.kind = 'in'").select("policy_id", "rule_id", target.alias("target")).join(members, ["policy_id", "target"]).select("policy_id", "rule_id", "type")
    return every.unionAll(stated).unionAll(one).unionAll(within).distinct()


def distinct_conditions(rules: DataFrame) -> DataFrame:
    """rules with exact repeats of a condition within a rule dropped, in order, and `n_dropped`."""
    r = F.col("rule")
    kept = F.array_distinct(r["conditions"])
    return rules.withColumn("n_dropped", F.size(r["conditions"]) - F.size(kept)).withColumn("rule", r.withField("conditions", kept))


def semantic_hash(rules: DataFrame, entities: DataFrame) -> DataFrame:
    """(policy_id, sha256) of what a policy means: its entities and its rules without their ids, each side in a fixed order; conditions keep theirs.

    Both sides are summed up by order-free sums of hashes, so policies of any size need no list in one row.
    """
    def digest(df: DataFrame, value: Column, name: str) -> DataFrame:
        h = F.sha2(value, 256)
        parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
        return df.groupBy("policy_id").agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts).alias(name))

    meaning = F.to_json(F.struct(F.col("rule.effect").alias("effect"), F.col("rule.principal").alias("principal"), F.array_sort("rule.actions").alias("actions"), F.col("rule.resource").alias("resource"), F.col("rule.conditions").alias("conditions")))
    both = digest(rules, meaning, "_r").join(digest(entities, F.concat_ws("|", "key", "type"), "_e"), "policy_id", "full_outer")
    return both.select("policy_id", F.sha2(F.concat_ws("#", F.coalesce("_r", F.lit("")), F.coalesce("_e", F.lit(""))), 256).alias("sha256"))


def sum_logprob(logits: Column, targets: Column, start: int = 1) -> Column:
    """Sum over t >= start of the log-probability of targets[t] under the logits at t - 1 (an array of arrays)."""
    def one(row: Column, target: Column) -> Column:
        top = F.array_max(row)
        total = F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
        return F.get(row, target).cast("double") - top - F.log(total)

    places = F.sequence(F.lit(start), F.size(targets) - 1)
    return F.when(F.size(targets) > start, F.aggregate(places, F.lit(0.0), lambda s, t: s + one(F.get(logits, t - 1), F.get(targets, t))))


def learning_rate(step: Column, total: int, warmup: int, peak: float) -> Column:
    """Linear warm-up, then a cosine down to 0."""
    progress = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def conversion_metrics(conversions: DataFrame, by: list[str]) -> DataFrame:
    """Per rendering: how often a conversion is readable, valid, exact, equivalent and wrong though readable, as means over worlds, and mean tokens.

    conversions: world_id, category (ir where it could be read), valid, exact, equivalent, prompt_tokens, output_tokens.
    """
    from .metrics import macro, per_world

    read = F.col("category") == "ir"
    no = F.lit(False)
    names = {"readable": read, "valid": F.coalesce(F.col("valid"), no), "exact": F.coalesce(F.col("exact"), no), "equivalent": F.coalesce(F.col("equivalent"), no), "wrong_if_read": F.when(read, ~F.coalesce(F.col("equivalent"), no))}
    rates = macro(per_world(conversions, by, names), by, list(names)).select(*by, *names)
    tokens = conversions.groupBy(*by).agg(F.count(F.lit(1)).alias("conversions"), F.avg("prompt_tokens").alias("prompt_tokens"), F.avg("output_tokens").alias("output_tokens"))
    return rates.join(tokens, by)


def floor_ceiling(rates: DataFrame, value: str, fixed: str) -> DataFrame:
    """One row: the rate of one fixed rendering, best and worst, and how far between them it lies (null where they are equal)."""
    ends = rates.agg(F.max(F.when(F.col("rendering") == fixed, F.col(value))).alias("fixed"), F.max(value).alias("best"), F.min(value).alias("worst"))
    return ends.withColumn("ceiling", F.try_divide(F.col("fixed") - F.col("worst"), F.col("best") - F.col("worst")))


def largest_change(base: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """One row: the largest difference of a rate over renderings between two runs, the base's gap, and whether the one reaches the other."""
    both = base.select("rendering", F.col(value).alias("a")).join(other.select("rendering", F.col(value).alias("b")), "rendering")
    found = both.agg(F.max(F.abs(F.col("b") - F.col("a"))).alias("largest"), (F.max("a") - F.min("a")).alias("base_gap"), F.max_by("rendering", F.struct(F.abs(F.col("b") - F.col("a")), "rendering")).alias("rendering"))
    return found.withColumn("exceeds", F.col("largest") >= F.col("base_gap"))


def bootstrap_balanced_accuracy(rows: DataFrame, truth: str, predicted: str, drawn: DataFrame, unit: str) -> DataFrame:
    """(replicate, mean): balanced accuracy of each replicate of a cluster bootstrap; replicates of one class are left out. drawn: see stats.weights.

    Rows are summed up per unit and class before they meet the replicates.
    """
    cells = rows.groupBy(unit, truth).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(predicted)).alias("k"))
    recall = cells.join(drawn, unit).groupBy("replicate", truth).agg((F.sum(F.col("k") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("r"))
    return recall.groupBy("replicate").agg(F.count(F.lit(1)).alias("classes"), F.avg("r").alias("mean")).where("classes > 1").select("replicate", "mean")
