"""Paired contrasts of factorial studies: effects against a base condition, spreads over representations, equal-weight means over families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import counter_hash


def effect_matrix(rows: DataFrame, unit: str, condition: str, base: str, outcomes: list[str]) -> DataFrame:
    """(treated, outcome, n, effect): mean over units of the treated less the base mean within the unit; units without both are left out.

    The conditions of a unit are gathered to one map, so pairs are made within a row.
    """
    cells = rows.groupBy(unit, condition).agg(*(F.avg(F.col(o).cast("double")).alias(o) for o in outcomes))
    maps = cells.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(F.col(condition), F.struct(*outcomes)))).alias("m")).where(F.map_contains_key("m", base))
    treated = maps.select(F.explode(F.map_filter("m", lambda k, _: k != base)).alias("treated", "t"), F.element_at("m", base).alias("b"))
    long = treated.select("treated", F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), (F.col(f"t.{o}") - F.col(f"b.{o}")).alias("d")) for o in outcomes))).alias("x"))
    return long.groupBy("treated", "x.outcome").agg(F.count("x.d").alias("n"), F.avg("x.d").alias("effect"))


def interaction(rows: DataFrame, unit: str, a: Column, b: Column, value: Column) -> DataFrame:
    """(unit, interaction): difference in differences of a value over two binary factors, null where a cell is empty."""
    cell = lambda x, y: F.avg(F.when((a == x) & (b == y), value))
    return rows.groupBy(unit).agg((cell(True, True) - cell(True, False) - cell(False, True) + cell(False, False)).alias("interaction"))


def representation_spread(rows: DataFrame, unit: list[str], representation: str, value: str, answer: str) -> DataFrame:
    """Per unit: range and variance (over the whole) of the value's means by representation, and whether answers differ."""
    cells = rows.groupBy(*unit, representation).agg(F.avg(value).alias("v"), F.max(answer).alias("most"), F.min(answer).alias("least"))
    return cells.groupBy(*unit).agg(F.count(F.lit(1)).alias("representations"), (F.max("v") - F.min("v")).alias("range"), F.var_pop("v").alias("variance"), (F.max("most") != F.min("least")).alias("differ"))


def family_mean(values: DataFrame, family: str, value: str) -> DataFrame:
    """One row: the mean of the families' means, each family weighing the same, and how many there are."""
    return values.groupBy(family).agg(F.avg(value).alias("m")).agg(F.count("m").alias("families"), F.avg("m").alias("mean"))


def family_bootstrap(values: DataFrame, family: str, unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): units redrawn within each family, families weighing the same.

    A unit's weight in a replicate is how many draws of its family fall on its place, so families are resampled apart and together in one join.
    """
    from pyspark.sql import Window

    placed = values.where(F.col(value).isNotNull()).withColumn("at", F.row_number().over(Window.partitionBy(family).orderBy(unit)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(family)))
    draws = placed.select(family, "at", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = draws.select(family, "replicate", (counter_hash(F.lit(seed), F.col(family), F.col("replicate"), F.col("at")) % F.col("n")).cast("int").alias("at"))
    weights = drawn.groupBy(family, "replicate", "at").agg(F.count(F.lit(1)).alias("weight"))
    means = weights.join(placed, [family, "at"]).groupBy(family, "replicate").agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("m"))
    return means.groupBy("replicate").agg(F.avg("m").alias("mean"))
