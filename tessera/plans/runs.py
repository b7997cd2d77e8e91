"""Queries of runs, licenses and releases, with customers as runs and documents' sources as what is passed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import runs as R
from ..sources.storage import new_folder
from . import fixtures as X

_OPEN = ["CC0-1.0", "MIT"]


def run_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each customer, done as far as their orders; wanted are those of all customers and as many that are not there."""
    orders = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("completed"))
    c = X.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").join(orders, "c_custkey", "left")
    k, done = F.col("c_custkey"), F.coalesce("completed", F.lit(0))
    runs = c.where(k % 13 != 0).select(k.alias("run"), F.when(k % 5 == 0, "running").otherwise("complete").alias("status"), done.alias("completed"), (done + F.when(k % 7 == 0, 1).otherwise(0)).alias("total"), F.col("c_mktsegment").alias("dataset"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("revision"))
    wanted = c.select(k.alias("run"), done.alias("total"), F.when(k % 9 == 0, F.lit("other")).otherwise(F.col("c_mktsegment")).alias("dataset"), F.col("c_nationkey").alias("revision"))
    problems = R.admission(runs, wanted, "run", ["dataset", "revision"])
    counts = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("found"))
    fit = R.admitted(wanted, problems, "run").agg(F.count(F.lit(1)).alias("n")).select(F.lit("admitted").alias("problem"), "n", F.lit(0).cast("bigint").alias("found"))
    return counts.unionAll(fit)


def license_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents whose license (drawn by a hash of their name) is unknown or not open."""
    used = X.table(spark, sf_dir, "documents").select("source").where("source is not null")
    kind = F.conv(F.substring(F.md5("source"), 1, 4), 16, 10).cast("int") % 4
    licenses = used.distinct().select("source", kind.alias("k")).where("k != 3").select("source", F.element_at(F.array(F.lit("MIT"), F.lit("CC0-1.0"), F.lit("BUSL-1.1")), (F.col("k") + 1).cast("int")).alias("license"))
    return R.license_problems(used, licenses, _OPEN)


def registry_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models, some lacking what they must state; sets are suppliers' parts, some of which do not exist."""
    p = X.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    models = p.select(k.cast("string").alias("model"), F.when(k % 10 != 0, F.col("p_name")).alias("name"), F.col("p_retailprice").cast("string").alias("revision"), F.when(k % 15 != 0, F.col("p_size")).alias("params_b"), F.col("p_brand").alias("precision"), F.when(k % 6 != 0, F.col("p_type")).alias("quantization"))
    members = X.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * F.when(F.col("l_linenumber") == 1, 3).otherwise(1)).cast("string").alias("model"), (F.col("l_suppkey") % 4).cast("string").alias("set")).distinct()
    found = R.registry_problems(models, members)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("name").cast("bigint")).alias("first"))


def release_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and documents' lengths written as a release and read back after every file has been checked."""
    c = X.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("nation"))
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark, "release")
    R.write_release({"customers": c, "documents": d}, path)
    people = R.read_release(spark, path, "customers", "c_custkey bigint, c_name string, nation bigint")
    texts = R.read_release(spark, path, "documents", "doc_id bigint, text string")
    mark = lambda c: F.sum(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"))
    one = people.agg(F.count(F.lit(1)).alias("n"), F.count("nation").alias("stated"), mark(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name")).alias("digest")).withColumn("name", F.lit("customers"))
    two = texts.agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("stated"), mark("text").alias("digest")).withColumn("name", F.lit("documents"))
    return one.unionByName(two)


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as half-precision shards and read back by a range of ids: how many of each label come back, all their values within the rounding."""
    from ..sources import vector_store as VS

    VS.register(spark)
    own = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "label", F.col("embedding").cast("array<float>").alias("embedding"))
    path = new_folder(spark, "vectors")
    own.select("id", F.col("embedding").alias("vector")).repartitionByRange(8, "id").write.format("vectors").mode("append").save(path)
    back = spark.read.format("vectors").load(path).where("id >= 100 and id < 900")
    near = F.forall(F.zip_with("embedding", "vector", lambda a, b: F.abs(a - b) <= F.abs(a) / 2048 + 1e-7), lambda x: x)
    return own.join(back, "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(near & (F.size("embedding") == F.size("vector"))).alias("close"), F.min("id").alias("first"), F.max("id").alias("last"))


SQL = {
    "vector_store": "SELECT label, count(*) AS n, count(*) AS close, CAST(min(vec_id) AS BIGINT) AS first, CAST(max(vec_id) AS BIGINT) AS last FROM embeddings WHERE vec_id >= 100 AND vec_id < 900 GROUP BY label",
    "run_admission": """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT c_custkey AS k, coalesce(n, 0) AS n FROM customer LEFT JOIN o ON c_custkey = k),
p AS (SELECT k, 'missing' AS problem, 0 AS found FROM c WHERE k % 13 = 0 UNION ALL SELECT k, 'not complete', 1 FROM c WHERE k % 13 != 0 AND (k % 5 = 0 OR k % 7 = 0) UNION ALL SELECT k, 'rows', 1 FROM c WHERE k % 13 != 0 AND k % 7 = 0
  UNION ALL SELECT k, 'dataset', 1 FROM c WHERE k % 13 != 0 AND k % 9 = 0 UNION ALL SELECT k, 'revision', 0 FROM c WHERE k % 13 != 0 AND k % 11 = 0)
SELECT problem, count(*) AS n, CAST(sum(found) AS BIGINT) AS found FROM p GROUP BY problem UNION ALL SELECT 'admitted', count(*), 0 FROM c WHERE k NOT IN (SELECT k FROM p)""",
    "license_gaps": """WITH s AS (SELECT source, count(*) AS n, ('0x' || substr(md5(source), 1, 4))::BIGINT % 4 AS k FROM documents WHERE source IS NOT NULL GROUP BY ALL)
SELECT source, CASE k WHEN 2 THEN 'BUSL-1.1' END AS license, n AS rows FROM s WHERE k >= 2""",
    "registry_gaps": """WITH m AS (SELECT DISTINCT l_partkey * CASE WHEN l_linenumber = 1 THEN 3 ELSE 1 END AS p, l_suppkey % 4 AS s FROM lineitem)
SELECT problem, count(*) AS n, min(p) AS first FROM (SELECT 'no name' AS problem, p_partkey AS p FROM part WHERE p_partkey % 10 = 0 OR p_name IS NULL UNION ALL SELECT 'no params_b', p_partkey FROM part WHERE p_partkey % 15 = 0 UNION ALL SELECT 'no quantization', p_partkey FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT 'unknown in ' || s, p FROM m WHERE p NOT IN (SELECT p_partkey FROM part)) GROUP BY problem""",
    "release_round_trip": """SELECT 'customers' AS name, count(*) AS n, count(*) FILTER (c_custkey % 3 != 0 AND c_nationkey IS NOT NULL) AS stated, CAST(sum(('0x' || substr(md5(c_custkey || '|' || c_name), 1, 8))::BIGINT) AS BIGINT) AS digest FROM customer
UNION ALL SELECT 'documents', count(*), count(text), CAST(sum(('0x' || substr(md5(text), 1, 8))::BIGINT) AS BIGINT) FROM documents""",
}

QUERIES = {f.__name__: f for f in (run_admission, license_gaps, registry_gaps, release_round_trip, vector_store)}
