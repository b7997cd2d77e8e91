"""Resampling by counter-based hashing, and tests and corrections as windows.

A draw is md5(seed | replicate | position) modulo the number of units, so it is the same on any cluster, in any order, and in SQL.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Units (worlds) that a bootstrap resamples at most.
MOST_UNITS = 1_000_000


def counter_hash(*parts: Column) -> Column:
    """48 bits of md5 over the parts joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("long")


def weights(units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, unit, weight): how often each unit is drawn in each bootstrap replicate of as many draws as units.

    Made once and shared by all metrics of an analysis, so that arms and renderings are resampled alike. Units are worlds, the
    sampling unit of a study: the number of weights is replicates x worlds and does not grow with answers.
    """
    numbered = units.select(unit).distinct()
    n = numbered.count()
    if n > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units are no sampling units of a study")
    w = Window.orderBy(unit)  # one task, of so many units at most
    numbered = numbered.withColumn("at", F.row_number().over(w) - 1)
    draws = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), "at")
    drawn = draws.select("replicate", (counter_hash(F.lit(seed), F.col("replicate"), F.col("at")) % n).alias("at"))
    return drawn.groupBy("replicate", "at").agg(F.count(F.lit(1)).alias("weight")).join(F.broadcast(numbered), "at").select("replicate", unit, "weight")


def bootstrap_means(values: DataFrame, by: list[str], value: str, drawn: DataFrame, unit: str = "world_id") -> DataFrame:
    """(by.., replicate, mean): weighted means over units, nulls left out."""
    both = values.where(F.col(value).isNotNull()).join(drawn, unit)
    return both.groupBy(*by, "replicate").agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("mean"))


def mean_difference(values: DataFrame, value: str, side: str, first: str, second: str, unit: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): the difference of the means of two independent samples, each redrawn on its own; units are one row each."""
    def drawn(name: str, offset: int) -> DataFrame:
        own = values.where((F.col(side) == name) & F.col(value).isNotNull())
        return bootstrap_means(own, [], value, weights(own, unit, replicates, seed + offset), unit)

    return drawn(first, 0).join(drawn(second, 1).withColumnRenamed("mean", "_other"), "replicate").select("replicate", (F.col("mean") - F.col("_other")).alias("mean"))


def interval(means: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """(by.., low, high): linearly interpolated quantiles of the replicates."""
    tail = (1 - level) / 2
    q = F.expr(f"percentile(mean, array({tail}, {1 - tail}))")
    return means.groupBy(*by).agg(q.alias("q")).select(*by, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def two_sided_p(means: DataFrame, by: list[str]) -> DataFrame:
    """Twice the smaller share of replicates on one side of zero; sums that differ from zero by rounding alone are zero."""
    share = lambda c: F.avg(c.cast("double"))
    mean = F.round("mean", 12)
    return means.groupBy(*by).agg(F.least(F.lit(1.0), 2 * F.least(share(mean <= 0), share(mean >= 0))).alias("p"))


def sign_permutation(values: DataFrame, by: list[str], value: str, unit: str, permutations: int, seed: int) -> DataFrame:
    """(by.., n, mean, p): sign-flip test of a mean of zero, with one added to both counts."""
    signs = values.where(F.col(value).isNotNull()).select(*by, unit, value, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("k"))
    flipped = F.when(counter_hash(F.lit(seed), F.col("k"), F.col(unit)) % 2 == 0, F.col(value)).otherwise(-F.col(value))
    means = signs.groupBy(*by, "k").agg(F.avg(flipped).alias("m"))
    observed = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    hits = means.join(observed, by).groupBy(*by, "n", "mean").agg(F.count_if(F.abs("m") >= F.abs("mean") - 1e-12).alias("hits"))
    return hits.select(*by, "n", "mean", ((F.col("hits") + 1) / (permutations + 1)).alias("p"))


def holm(tests: DataFrame, p: str, order: list[str], family: list[str] | None = None) -> DataFrame:
    """Add p_holm: step-down adjusted, ties in the given order."""
    by = Window.partitionBy(*(family or []))
    ranked = tests.withColumn("_r", F.row_number().over(by.orderBy(p, *order))).withColumn("_m", F.count(p).over(by))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return ranked.withColumn("p_holm", F.max(step).over(by.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m")


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str], family: list[str] | None = None) -> DataFrame:
    """Add q: the least p * m / rank of this test and all with larger p; null p stays null and does not count."""
    by = Window.partitionBy(*(family or []), F.col(p).isNull())
    ranked = tests.withColumn("_r", F.row_number().over(by.orderBy(p, *order))).withColumn("_m", F.count(p).over(by))
    step = F.col(p) * F.col("_m") / F.col("_r")
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(step).over(by.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))))).drop("_r", "_m")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(points: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """(by.., n, rho): rank correlation with average ranks, null for fewer points than `least` or a constant side."""
    ranked = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))).alias("rho"))


def rank_permutation(points: DataFrame, x: str, y: str, by: list[str], unit: str, permutations: int, seed: int, least: int = 3) -> DataFrame:
    """(by.., p): the share of permutations of one side's ranks whose correlation is at least as far from zero; groups without a correlation are left out.

    A permutation puts the units in order of a hash of (seed, permutation, unit), then unit, and meets them with the ranks of y in order of unit.
    Products of ranks are multiples of a quarter, so sums are exact in any order. Both sides of a group lie in one row, as the units are a study's worlds.
    """
    ranked = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    sides = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col("_x").alias("x"), F.col("_y").alias("y")))).alias("_s"), F.covar_pop("_x", "_y").alias("_c"), (F.stddev_pop("_x") * F.stddev_pop("_y")).alias("_d"))
    each = sides.where((F.col("_n") >= least) & (F.col("_d") > 0)).repartition(*by).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    mixed = F.array_sort(F.transform("_s", lambda s: F.struct(counter_hash(F.lit(seed), F.col("_k"), s["u"]).alias("h"), s["u"].alias("u"), s["x"].alias("x"))))
    total = F.aggregate(F.zip_with(mixed, "_s", lambda a, b: a["x"] * b["y"]), F.lit(0.0), lambda a, b: a + b)
    mean = (F.col("_n") + 1) / 2
    far = F.abs((total / F.col("_n") - mean * mean) / F.col("_d")) >= F.abs(F.col("_c") / F.col("_d")) - 1e-12
    return each.groupBy(*by).agg(F.avg(far.cast("double")).alias("p"))


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided binomial p of discordant counts b and c; 1 where there are none."""
    @F.pandas_udf("double")
    def tail(b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x: int, y: int) -> float:
            n, k = int(x + y), int(min(x, y))
            if not n:
                return 1.0
            # Each term is the one above it times a ratio that falls, so a few roots of n terms are all that count.
            term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
            total = 0.0
            while term > total * 1e-17:
                total += term
                term *= k / (n - k + 1)
                k -= 1
            return min(1.0, 2 * total)

        return pd.Series([one(x, y) for x, y in zip(b, c)], dtype=float)

    return tail(b, c)
