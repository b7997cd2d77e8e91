"""Random policies by counter-based hashing, and the bar that keeps those worth asking about.

A draw is a hash of (seed, policy, what is drawn), so a policy is the same wherever and whenever it is drawn, and no generator state is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RULE
from . import policy as P
from .stats import counter_hash


def _pick(options: list[str], *parts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (counter_hash(*parts) % len(options) + 1).cast("int"))


def draw_rules(policies: DataFrame, groups: list[str], actions: list[str], principal: str, resource: str, attribute: str, limit: int, seed: int, most: int = 3) -> DataFrame:
    """(policy_id, rule): 1 to `most` rules for each policy_id, a third of them forbids.

    A rule's principals are one group's members or all of a type, its actions one or two, its resources all of a type; half the rules compare an
    integer attribute of the resource with a threshold below `limit`.
    """
    p, s, k = F.col("policy_id"), F.lit(seed), F.col("k")
    each = policies.select("policy_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), (counter_hash(s, p, F.lit("n")) % most).cast("int"))))
    h = lambda what: counter_hash(s, p, k, F.lit(what))
    none_e, none_s = F.lit(None).cast("struct<type:string,id:string>"), F.lit(None).cast("string")
    member = F.struct(F.lit("in").alias("kind"), F.struct(F.lit("group").alias("type"), _pick(groups, s, p, k, F.lit("group")).alias("id")).alias("entity"), none_s.alias("type"))
    typed = lambda kind: F.struct(F.lit("is").alias("kind"), none_e.alias("entity"), F.lit(kind).alias("type"))
    no_value = F.lit(None).cast("struct<t:string,s:string,i:bigint,b:boolean>")
    threshold = F.struct(F.lit("int").alias("t"), none_s.alias("s"), (h("threshold") % limit).alias("i"), F.lit(None).cast("boolean").alias("b"))
    condition = F.struct(F.struct(F.lit("resource").alias("subject"), F.lit(attribute).alias("attr"), no_value.alias("value")).alias("left"), _pick(["<", ">="], s, p, k, F.lit("op")).alias("op"), F.struct(none_s.alias("subject"), none_s.alias("attr"), threshold.alias("value")).alias("right"))
    named = F.array_sort(F.array_distinct(F.array(_pick(actions, s, p, k, F.lit("a")), _pick(actions, s, p, k, F.lit("b")))))
    rule = F.struct(
        F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), F.when(h("effect") % 3 == 0, "forbid").otherwise("permit").alias("effect"), F.when(h("who") % 3 == 0, typed(principal)).otherwise(member).alias("principal"),
        named.alias("actions"), typed(resource).alias("resource"), F.slice(F.array(condition), F.lit(1), (h("when") % 2).cast("int")).alias("conditions"),
    )
    return each.select("policy_id", rule.cast(RULE).alias("rule"))


def keep_reason(decided: DataFrame, rules: DataFrame, least: int) -> DataFrame:
    """(policy_id, reason): ok, or why a policy is not worth asking about: too few of a decision, too few on the boundary, a dead rule.

    decided: labelled requests with decision and boundary.
    """
    counts = decided.groupBy("policy_id").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("allow", "deny")), *(F.count_if((F.col("decision") == d) & F.col("boundary")).alias(f"{d}_edge") for d in ("allow", "deny")))
    live = P.decisive_rules(decided).groupBy("policy_id").agg(F.count(F.lit(1)).alias("live"))
    total = rules.groupBy("policy_id").agg(F.count(F.lit(1)).alias("rules"))
    both = counts.join(total, "policy_id").join(live, "policy_id", "left")
    edge = (F.col("allow_edge") < least // 2) | (F.col("deny_edge") < least // 2)
    dead = (F.col("rules") > 1) & (F.coalesce("live", F.lit(0)) < F.col("rules"))
    return both.select("policy_id", F.when(F.col("allow") < least, "too few allowed").when(F.col("deny") < least, "too few denied").when(edge, "too few on the boundary").when(dead, "dead rule").otherwise("ok").alias("reason"))
