"""World-clustered metrics over scored answers.

A row is one answer: world_id, assignment, instance, rendering, label (allow or deny), category and value (the decision
given, null if none). Rates are macro averages: the mean over worlds of the mean within a world, where a tri-state predicate (true,
false, null) leaves rows out of numerator and denominator alike. All take one partial aggregate per (rendering, world) first,
so that what moves is as small as worlds x renderings, however many rows a world has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSTANCE = ["world_id", "assignment", "instance"]
RATES = ("accuracy", "deny_to_allow", "allow_to_deny", "refusal", "abstain", "parse_failure")


def answer_predicates() -> dict[str, Column]:
    """The tri-state predicates of an answer; the directional ones are undefined for rows of the other label."""
    category, label, value = F.col("category"), F.col("label"), F.col("value")
    wrong = category == "incorrect"
    return {
        "accuracy": category == "correct",
        "deny_to_allow": F.when(label == "deny", wrong & F.coalesce(value == "allow", F.lit(False))),
        "allow_to_deny": F.when(label == "allow", wrong & F.coalesce(value == "deny", F.lit(False))),
        "refusal": category == "refusal",
        "abstain": category == "abstain",
        "parse_failure": category == "parse_failure",
    }


def per_world(rows: DataFrame, by: list[str], predicates: dict[str, Column]) -> DataFrame:
    """Mean of each predicate per (by.., world); null where a world has no defined row."""
    return rows.groupBy(*by, "world_id").agg(*(F.avg(p.cast("double")).alias(n) for n, p in predicates.items()))


def macro(worlds: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean over worlds of each column, and how many worlds define it."""
    columns = [c for n in names for c in (F.avg(n).alias(n), F.count(n).alias(f"{n}_worlds"))]
    return worlds.groupBy(*by).agg(*columns)


def best_and_worst(rates: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(best, worst): of equal rates the larger name is best, the smaller worst."""
    order = F.struct(value, "rendering")
    return rates.groupBy(*(by or [])).agg(F.max_by("rendering", order).alias("best"), F.min_by("rendering", order).alias("worst"))


def paired_gap(worlds: DataFrame, value: str) -> DataFrame:
    """(best, worst, world_id, diff): the difference within each world between the best and the worst rendering overall."""
    ends = F.broadcast(best_and_worst(macro(worlds, ["rendering"], [value]), value))
    each = worlds.join(ends, (F.col("rendering") == F.col("best")) | (F.col("rendering") == F.col("worst")))
    at = lambda side: F.max(F.when(F.col("rendering") == F.col(side), F.col(value)))
    return each.groupBy("best", "worst", "world_id").agg((at("best") - at("worst")).alias("diff"))


def full_instances(rows: DataFrame, renderings: int) -> DataFrame:
    """Per instance present in every rendering: whether answers differ, all are right, and errors in either direction occur.

    An answer is its value, or its category where it has none.
    """
    answer = F.coalesce("value", "category")
    wrong = F.col("category") == "incorrect"
    each = rows.groupBy(*INSTANCE, "label").agg(
        F.count_distinct("rendering").alias("n"), F.count_distinct(answer).alias("answers"), F.min((F.col("category") == "correct").cast("int")).alias("all_correct"),
        F.max((wrong & (F.col("value") == "allow")).cast("int")).alias("to_allow"), F.max((wrong & (F.col("value") == "deny")).cast("int")).alias("to_deny"),
    )
    return each.where(F.col("n") == renderings).withColumn("disagrees", (F.col("answers") > 1).cast("int")).drop("n")


def pairwise_flips(rows: DataFrame) -> DataFrame:
    """(a, b, flips, instances): instances answered rightly under rendering a and wrongly under b.

    Answers of an instance are gathered to one map, at most one entry per rendering, and pairs are made within the row.
    """
    maps = rows.groupBy(*INSTANCE).agg(F.map_from_entries(F.collect_set(F.struct("rendering", "category"))).alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    pairs = F.flatten(F.transform(keys, lambda a: F.transform(F.filter(keys, lambda b: b != a), lambda b: F.struct(a.alias("a"), b.alias("b"), ((F.element_at("m", a) == "correct") & (F.element_at("m", b) == "incorrect")).cast("int").alias("flip")))))
    return maps.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.flip").alias("flips"), F.count(F.lit(1)).alias("instances"))


def dissociation(application: DataFrame, interpretation: DataFrame) -> DataFrame:
    """Per (rendering, world): joint failure (wrong use of a rule rightly read) and the rate of wrong use given a right reading."""
    keys = [*INSTANCE, "rendering"]
    read = interpretation.dropDuplicates(keys).select(*keys, (F.col("category") == "correct").alias("read"))
    both = application.join(read, keys).withColumn("wrong", F.col("category") != "correct")
    return per_world(both, ["rendering"], {"joint": F.col("wrong") & F.col("read"), "conditional": F.when(F.col("read"), F.col("wrong"))})


def contrasts(worlds: DataFrame, value: str) -> DataFrame:
    """(rendering, world_id, diff): each rendering's rate less the mean of the other renderings in the world, nulls left out."""
    w = Window.partitionBy("world_id")
    others = F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1)
    return worlds.select("rendering", "world_id", (F.col(value) - others).alias("diff"))


def majority_vote(rows: DataFrame, tie: str = "abstain") -> DataFrame:
    """Per instance: the value most renderings gave; a tie for first place or no vote abstains, or denies with tie='deny'."""
    votes = rows.groupBy(*INSTANCE, "label").agg(
        F.count_if(F.col("value") == "allow").alias("allows"), F.count_if(F.col("value") == "deny").alias("denies"), F.sum("tokens").alias("tokens"),
    )
    other = F.lit(None).cast("string") if tie == "abstain" else F.lit("deny")
    value = F.when(F.col("allows") > F.col("denies"), "allow").when(F.col("denies") > F.col("allows"), "deny").otherwise(other)
    voted = votes.withColumn("value", value)
    category = F.when(F.col("value").isNull(), "abstain").when(F.col("value") == F.col("label"), "correct").otherwise("incorrect")
    return voted.withColumn("category", category)


def fail_closed(rows: DataFrame) -> DataFrame:
    """Answers without a value deny."""
    value = F.coalesce("value", F.lit("deny"))
    return rows.withColumn("category", F.when(value == F.col("label"), "correct").otherwise("incorrect")).withColumn("value", value)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., side): keys that only one of two arms has; arms can be compared if there are none."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return a.join(b, keys, "full_outer").where("_l is null or _r is null").select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def gap_closure(arm: DataFrame, base: DataFrame, value: str = "accuracy") -> DataFrame:
    """One row: gaps of arm and baseline, how far the arm closes the baseline's gap by its own and by the baseline's pair, and the change of the worst rate.

    Ratios with a gap of zero below are null.
    """
    gap = lambda df, name: paired_gap(df, value).agg(F.avg("diff").alias(name))
    ends = best_and_worst(macro(base, ["rendering"], [value]), value)
    pair = arm.join(F.broadcast(ends), (F.col("rendering") == F.col("best")) | (F.col("rendering") == F.col("worst")))
    at = lambda side: F.max(F.when(F.col("rendering") == F.col(side), F.col(value)))
    pair = pair.groupBy("world_id").agg((at("best") - at("worst")).alias("d")).agg(F.avg("d").alias("pair_gap"))
    floor = lambda df, name: macro(df, ["rendering"], [value]).agg(F.min(value).alias(name))
    parts = [gap(arm, "arm_gap"), gap(base, "base_gap"), pair, floor(arm, "arm_floor"), floor(base, "base_floor")]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # five tables of one row each
    closed = lambda n: 1 - F.try_divide(F.col(n), F.col("base_gap"))
    return one.withColumns({"own_closure": closed("arm_gap"), "pair_closure": closed("pair_gap"), "floor_change": F.col("arm_floor") - F.col("base_floor")})


def token_cost(conversions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per rendering: mean tokens of a query when each cell's conversion (world, assignment, rendering) is shared by its queries."""
    cell = ["world_id", "assignment", "rendering"]
    queries = answers.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("answer_tokens"))
    both = queries.join(conversions.select(*cell, F.col("tokens").alias("conversion_tokens")), cell, "left")
    return both.groupBy("rendering").agg(F.sum("n").alias("queries"), F.try_divide(F.sum(F.coalesce("conversion_tokens", F.lit(0))), F.sum("n")).alias("shared_conversion"), (F.sum("answer_tokens") / F.sum("n")).alias("answer"))
