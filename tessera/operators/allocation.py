"""Designs that are balanced by construction: ranks in a seeded order, factors by mixed radix, quotas by largest remainder, and draws until a quota is met.

Order comes from a hash of (seed, key), so results are the same however rows are partitioned. Ranks are the counts of earlier buckets of that hash plus
the rank within a bucket, so no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


def seeded(seed: int, *keys: Column | str) -> Column:
    """The place of a row in a seeded order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k) if isinstance(k, str) else k for k in keys)))


def ranked(rows: DataFrame, by: list[str], order: Column, name: str = "rank", digits: int = 3) -> DataFrame:
    """rows with their rank (from 0) within each group, in the order of a hexadecimal hash. digits: of the hash, for buckets."""
    marked = rows.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, digits))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "_bucket")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    within = F.row_number().over(Window.partitionBy(*(f"r.{c}" for c in (*by, "_bucket"))).orderBy("r._order"))
    return marked.alias("r").join(counts.alias("c"), on).select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("c._first") + within - 1).alias(name))


def counterbalanced(rows: DataFrame, by: list[str], order: Column, factors: dict[str, list[str]]) -> DataFrame:
    """rows with a level of every factor: within each group every combination comes as often as any other, to one row, and so does every level and pair of levels.

    The rank counts through the combinations, the last factor fastest; which combination a group begins with depends on the group, so that what is left over is spread.
    """
    sizes = [len(levels) for levels in factors.values()]
    total = 1
    for n in sizes:
        total *= n
    start = F.conv(F.substring(F.md5(F.concat_ws("|", *by)), 1, 8), 16, 10).cast("bigint") if by else F.lit(0)
    out = ranked(rows, by, order, "_rank").withColumn("_cell", (F.col("_rank") + start) % total)
    step = total
    for (name, levels), n in zip(factors.items(), sizes):
        step //= n
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, levels)), (F.floor(F.col("_cell") / step) % n + 1).cast("int")))
    return out.drop("_rank", "_cell")


def imbalance(rows: DataFrame, by: list[str], factors: dict[str, list[str]]) -> DataFrame:
    """(by.., factor, least, most): how often the rarest and the commonest level of each factor and pair of factors come in each group; levels that never come count 0."""
    names = list(factors)
    wanted = [(n,) for n in names] + [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = F.explode(F.array(*(F.struct(F.lit(" x ".join(w)).alias("factor"), F.concat_ws("|", *w).alias("level")) for w in wanted)))
    counts = rows.select(*by, each.alias("x")).groupBy(*by, "x.factor", "x.level").agg(F.count(F.lit(1)).alias("n"))
    sizes = {" x ".join(w): len(factors[w[0]]) * (len(factors[w[1]]) if len(w) > 1 else 1) for w in wanted}
    size = F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("factor"))
    return counts.groupBy(*by, "factor").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("levels")).withColumn("least", F.when(F.col("levels") < size, 0).otherwise(F.col("least"))).drop("levels")


def largest_remainder(weights: DataFrame, by: list[str], stratum: str, weight: str, total: int) -> DataFrame:
    """(by.., stratum, quota): whole numbers in proportion to the weights that sum to `total` in each group; what is left over goes to the largest remainders, then to the first names."""
    whole = Window.partitionBy(*by)
    sum_ = F.sum(F.col(weight).cast("decimal(20,0)")).over(whole)
    exact = weights.withColumn("_sum", sum_).where("_sum > 0").withColumn("_share", F.col(weight).cast("decimal(20,0)") * total)
    floor = exact.withColumn("quota", F.expr("_share div _sum")).withColumn("_rest", F.expr("_share - quota * _sum"))
    left = F.lit(total) - F.sum("quota").over(whole)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_rest"), stratum))
    return floor.withColumn("_left", left).withColumn("_place", place).select(*by, stratum, (F.col("quota") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def draw_until(cells: DataFrame, judge: Callable[[DataFrame], DataFrame], most: int, batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """Draws of each cell until its quota is met: (accepted, report).

    cells (cell, quota, ..). judge takes cells with `attempt` (0, 1, ..) and adds what was drawn and `reason`, null for what is accepted; it must depend on
    the row alone. Each round only cells that lack something draw again, twice as many attempts as before. accepted: the first `quota` accepted draws of each cell. report (cell,
    quota, accepted, attempts, exhausted, reasons): attempts up to the last accepted one, or all `most` where the quota was not met, and how often each reason came in these.
    """
    pending, first, seen = cells, 0, None
    while first < most:
        n = min(batch, most - first)
        drawn = written(judge(pending.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))))
        seen = drawn if seen is None else seen.unionByName(drawn)
        first, batch = first + n, batch * 2
        enough = seen.groupBy("cell").agg(F.count_if(F.col("reason").isNull()).alias("_found"))
        pending = written(cells.join(enough, "cell", "left").where(F.coalesce("_found", F.lit(0)) < F.col("quota")).drop("_found"))
        if pending.isEmpty():
            break
    if seen is None:
        raise ValueError("there is nothing to draw with no attempts")
    order = Window.partitionBy("cell").orderBy("attempt")
    numbered = seen.withColumn("_nth", F.count_if(F.col("reason").isNull()).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # What comes after the last draw that is needed is as if it had not been drawn.
    needed = written(numbered.where((F.col("_nth") < F.col("quota")) | (F.col("_nth") == F.col("quota")) & F.col("reason").isNull()))
    accepted = needed.where("reason is null").drop("reason", "_nth")
    counts = needed.groupBy("cell", "reason").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.sum(F.when(F.col("reason").isNull(), F.col("n"))).alias("accepted"), F.sum("n").alias("attempts"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons"))
    none = F.lit(0).cast("bigint")
    both = cells.select("cell", "quota").join(counts, "cell", "left").withColumn("accepted", F.coalesce("accepted", none))
    return accepted, both.select("cell", "quota", "accepted", F.coalesce("attempts", none).alias("attempts"), (F.col("accepted") < F.col("quota")).alias("exhausted"), "reasons")
