"""Queries over balanced designs: counterbalanced factors, quotas in proportion, and draws until a quota is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation as A
from . import fixtures as X

FACTORS = {"form": ["json", "prose", "table"], "naming": ["orig", "swap"], "side": ["left", "right"]}
_BUDGET, _MOST = 1000, 48


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = X.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return A.counterbalanced(customer, ["c_nationkey"], A.seeded(3, F.col("c_custkey").cast("string")), FACTORS)


def counterbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition of each customer: every form, naming and side, and every pair of them, equally often in each nation."""
    return _placed(spark, sf_dir)


def design_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the rarest and the commonest level of each factor and pair come in each nation."""
    return A.imbalance(_placed(spark, sf_dir), ["c_nationkey"], FACTORS)


def mixture_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a thousand documents for each source: how many of each language, in proportion to the characters there are."""
    sums = X.table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.sum("n_chars").alias("chars"))
    return A.largest_remainder(sums, ["source"], "lang", "chars", _BUDGET)


def quota_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random thresholds for each nation and segment until enough of them split the cell's customers by balance: draws that leave too few on a side are counted and drawn again."""
    customer = X.table(spark, sf_dir, "customer")
    cell = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment")
    spread = customer.select(cell.alias("cell"), F.expr("cast(floor((c_acctbal + 1000) / 688) as int)").alias("bin")).groupBy("cell").agg(*(F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(16)), F.count(F.lit(1)).alias("size"))
    cells = spread.select("cell", (F.pmod(F.conv(F.substring(F.md5("cell"), 1, 4), 16, 10).cast("bigint"), F.lit(4)) + 1).cast("int").alias("quota"), F.array(*(f"b{i}" for i in range(16))).alias("bins"), "size")

    def judge(df: DataFrame) -> DataFrame:
        cut = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("11"), "cell", F.col("attempt").cast("string"))), 1, 6), 16, 10).cast("bigint") % 16).cast("int")
        below = F.aggregate(F.slice("bins", F.lit(1), F.col("cut")), F.lit(0).cast("bigint"), lambda s, x: s + x)
        out = df.withColumn("cut", cut).withColumn("below", below)
        return out.withColumn("reason", F.when(F.col("below") < 2, "too few below").when(F.col("size") - F.col("below") < 2, "too few above"))

    _, report = A.draw_until(cells, judge, _MOST)
    count = lambda r: F.coalesce(F.try_element_at("reasons", F.lit(r)), F.lit(0).cast("bigint"))
    return report.select("cell", "quota", "accepted", "attempts", "exhausted", count("too few below").alias("below"), count("too few above").alias("above"))


_PLACED = """o AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('3|' || c_custkey)) - 1 AS r, ('0x' || substr(md5(CAST(c_nationkey AS VARCHAR)), 1, 8))::BIGINT AS s FROM customer),
c AS (SELECT c_nationkey, c_custkey, (r + s) % 12 AS x FROM o),
p AS (SELECT c_nationkey, c_custkey, ['json', 'prose', 'table'][CAST(x // 4 + 1 AS INTEGER)] AS form, ['orig', 'swap'][CAST(x // 2 % 2 + 1 AS INTEGER)] AS naming, ['left', 'right'][CAST(x % 2 + 1 AS INTEGER)] AS side FROM c)"""

SQL = {
    "counterbalanced": f"WITH {_PLACED} SELECT * FROM p",
    "design_imbalance": f"""WITH {_PLACED},
l AS (SELECT c_nationkey, unnest([['form', form], ['naming', naming], ['side', side], ['form x naming', form || '|' || naming], ['form x side', form || '|' || side], ['naming x side', naming || '|' || side]]) AS v FROM p),
n AS (SELECT c_nationkey, v[1] AS factor, v[2] AS level, count(*) AS n FROM l GROUP BY ALL)
SELECT c_nationkey, factor, CASE WHEN count(*) < CASE factor WHEN 'form' THEN 3 WHEN 'naming' THEN 2 WHEN 'side' THEN 2 WHEN 'naming x side' THEN 4 ELSE 6 END THEN 0 ELSE min(n) END AS least, max(n) AS most FROM n GROUP BY c_nationkey, factor""",
    "mixture_quotas": f"""WITH w AS (SELECT source, coalesce(lang, 'und') AS lang, CAST(sum(n_chars) AS HUGEINT) AS w FROM documents GROUP BY ALL), s AS (SELECT *, sum(w) OVER (PARTITION BY source) AS t FROM w),
f AS (SELECT *, CAST(w * {_BUDGET} AS HUGEINT) // CAST(t AS HUGEINT) AS q FROM s WHERE t > 0), r AS (SELECT *, w * {_BUDGET} - q * t AS rest FROM f)
SELECT source, lang, CAST(q + (row_number() OVER (PARTITION BY source ORDER BY rest DESC, lang) <= {_BUDGET} - sum(q) OVER (PARTITION BY source))::INT AS BIGINT) AS quota FROM r""",
    "quota_draws": f"""WITH c AS (SELECT c_nationkey || '/' || c_mktsegment AS cell, count(*) AS size FROM customer GROUP BY ALL), q AS (SELECT cell, size, ('0x' || substr(md5(cell), 1, 4))::BIGINT % 4 + 1 AS quota FROM c),
a AS (SELECT cell, size, quota, k, ('0x' || substr(md5('11|' || cell || '|' || k), 1, 6))::BIGINT % 16 AS cut FROM q, (SELECT unnest(range(0, {_MOST})) AS k)),
b AS (SELECT c_nationkey || '/' || c_mktsegment AS cell, floor((c_acctbal + 1000) / 688) AS bin FROM customer),
d AS (SELECT a.cell, size, quota, k, count(b.cell) AS below FROM a LEFT JOIN b ON a.cell = b.cell AND bin < cut AND bin >= 0 GROUP BY ALL),
j AS (SELECT *, CASE WHEN below < 2 THEN 'below' WHEN size - below < 2 THEN 'above' END AS reason FROM d),
n AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY cell ORDER BY k ROWS UNBOUNDED PRECEDING) AS nth FROM j), u AS (SELECT * FROM n WHERE nth < quota OR nth = quota AND reason IS NULL)
SELECT cell, CAST(quota AS INTEGER) AS quota, count(*) FILTER (reason IS NULL) AS accepted, count(*) AS attempts, count(*) FILTER (reason IS NULL) < quota AS exhausted, count(*) FILTER (reason = 'below') AS below, count(*) FILTER (reason = 'above') AS above FROM u GROUP BY cell, quota""",
}

QUERIES = {f.__name__: f for f in (counterbalanced, design_imbalance, mixture_quotas, quota_draws)}
