"""Queries over factorial contrasts, with order lines, parts and documents as studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import designs as D
from ..operators import stats as S
from . import fixtures as X

REPLICATES = 4_000
_R = lambda c, name=None: F.round(c, 6).alias(name or c)


def effect_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of return flags A and R against N on three outcomes, within supplier."""
    lines = X.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("discounted"), (F.col("l_tax") > 0.04).cast("int").alias("taxed"), (F.col("l_quantity") > 25).cast("int").alias("large"))
    return D.effect_matrix(lines, "l_suppkey", "l_returnflag", "N", ["discounted", "taxed", "large"]).select("treated", "outcome", "n", _R("effect"))


def cell_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line status by return within part: does their joint effect on the discount differ from the sum of both?"""
    lines = X.table(spark, sf_dir, "lineitem")
    found = D.interaction(lines, "l_partkey", F.col("l_linestatus") == "F", F.col("l_quantity") > 25, F.col("l_discount"))
    return found.agg(F.count("interaction").alias("n"), _R(F.avg("interaction"), "interaction"), F.count_if(F.col("interaction") > 1e-9).alias("positive"))


def representation_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How answers vary over renderings of a document, by world."""
    rows = X.answers(spark, sf_dir).withColumn("right", (F.col("category") == "correct").cast("double")).withColumn("given", F.coalesce("value", "category"))
    each = D.representation_spread(rows, ["world_id", "instance"], "rendering", "right", "given")
    return each.groupBy("world_id").agg(F.count(F.lit(1)).alias("n"), _R(F.avg("range"), "range"), _R(F.avg("variance"), "variance"), F.count_if("differ").alias("differ"))


def family_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length contrast of languages' documents by source, languages weighing the same, with a bootstrap within language."""
    docs = X.table(spark, sf_dir, "documents").select("lang", "source", ((F.col("n_chars") % 997) / 997).alias("x"), (F.col("doc_id") % 2 == 0).alias("even"))
    side = lambda v: F.avg(F.when(F.col("even") == v, F.col("x")))
    values = docs.groupBy("lang", "source").agg((side(True) - side(False)).alias("d"))
    means = D.family_bootstrap(values, "lang", "source", "d", REPLICATES, 9)
    ends = S.interval(means.withColumn("mean", F.round("mean", 12)), [])
    return D.family_mean(values, "lang", "d").crossJoin(ends).select("families", _R("mean"), _R("low"), _R("high"))  # one row each


def two_way_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount for each ordered pair of supplier and customer region, and its difference from the reverse pair."""
    t = lambda n: X.table(spark, sf_dir, n)
    region = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    supplier = t("supplier").join(F.broadcast(region), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("a"))  # nations are 25
    customer = t("customer").join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("b"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    cells = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("m"))
    back = cells.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("reverse"))
    return cells.join(back, ["a", "b"], "left").select("a", "b", "n", _R("m", "mean"), _R(F.col("m") - F.col("reverse"), "asymmetry"))


SQL = {
    "effect_matrix": """WITH c AS (SELECT l_suppkey, l_returnflag, avg((l_discount > 0.05)::INT) AS a, avg((l_tax > 0.04)::INT) AS b, avg((l_quantity > 25)::INT) AS c FROM lineitem GROUP BY ALL),
p AS (SELECT t.l_returnflag AS treated, t.a - n.a AS a, t.b - n.b AS b, t.c - n.c AS c FROM c t JOIN c n ON t.l_suppkey = n.l_suppkey AND n.l_returnflag = 'N' WHERE t.l_returnflag != 'N')
SELECT treated, 'discounted' AS outcome, count(a) AS n, round(avg(a), 6) AS effect FROM p GROUP BY treated UNION ALL SELECT treated, 'taxed', count(b), round(avg(b), 6) FROM p GROUP BY treated UNION ALL SELECT treated, 'large', count(c), round(avg(c), 6) FROM p GROUP BY treated""",
    "cell_interaction": """WITH u AS (SELECT l_partkey, avg(l_discount) FILTER (l_linestatus = 'F' AND l_quantity > 25) - avg(l_discount) FILTER (l_linestatus = 'F' AND l_quantity <= 25) - avg(l_discount) FILTER (l_linestatus != 'F' AND l_quantity > 25) + avg(l_discount) FILTER (l_linestatus != 'F' AND l_quantity <= 25) AS i FROM lineitem GROUP BY l_partkey)
SELECT count(i) AS n, round(avg(i), 6) AS interaction, count(*) FILTER (i > 1e-9) AS positive FROM u""",
    "representation_spread": f"""WITH {X.answers_sql()}, c AS (SELECT world_id, instance, rendering, avg((category = 'correct')::INT) AS v, max(coalesce(value, category)) AS hi, min(coalesce(value, category)) AS lo FROM ans GROUP BY ALL),
u AS (SELECT world_id, instance, max(v) - min(v) AS r, var_pop(v) AS s, max(hi) != min(lo) AS d FROM c GROUP BY ALL)
SELECT world_id, count(*) AS n, round(avg(r), 6) AS range, round(avg(s), 6) AS variance, count(*) FILTER (d) AS differ FROM u GROUP BY world_id""",
    "family_contrast": f"""WITH v AS (SELECT lang, source, avg((n_chars % 997) / 997.0::DOUBLE) FILTER (doc_id % 2 = 0) - avg((n_chars % 997) / 997.0::DOUBLE) FILTER (doc_id % 2 != 0) AS d FROM documents GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM v WHERE d IS NOT NULL),
w AS (SELECT lang, r.k, ('0x' || substr(md5('9|' || lang || '|' || r.k || '|' || pos), 1, 12))::BIGINT % n AS pos FROM p, (SELECT unnest(range(0, {REPLICATES})) AS k) r),
m AS (SELECT w.lang, w.k, avg(p.d) AS m FROM w JOIN p USING (lang, pos) GROUP BY ALL), g AS (SELECT k, round(avg(m), 12) AS m FROM m GROUP BY k), f AS (SELECT lang, avg(d) AS m FROM v GROUP BY lang)
SELECT (SELECT count(m) FROM f) AS families, (SELECT round(avg(m), 6) FROM f) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM g""",
    "two_way_matrix": """WITH c AS (SELECT ra.r_name AS a, rb.r_name AS b, count(*) AS n, avg(l_discount) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation na ON s_nationkey = na.n_nationkey JOIN region ra ON na.n_regionkey = ra.r_regionkey JOIN nation nb ON c_nationkey = nb.n_nationkey JOIN region rb ON nb.n_regionkey = rb.r_regionkey GROUP BY ALL)
SELECT x.a, x.b, x.n, round(x.m, 6) AS mean, round(x.m - y.m, 6) AS asymmetry FROM c x LEFT JOIN c y ON x.a = y.b AND x.b = y.a""",
}

QUERIES = {f.__name__: f for f in (effect_matrix, cell_interaction, representation_spread, family_contrast, two_way_matrix)}
