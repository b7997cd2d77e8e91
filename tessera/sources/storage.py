"""Files: manifests with content hashes, canonical JSON lines, resumable appends and the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set a local session gets one of its own; a cluster must set one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or current.isDefined():
        return (named or current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df by way of a table in the shared folder, which cuts its lineage."""
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """df for joins that sort both sides. Files of rows that are much alike are far smaller than the rows, so that Spark would take many for few and gather them in the driver."""
    return df.hint("merge")


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256, git_sha1) of every file below a folder. A file is read whole by one task; empty files are left out, as Spark's sources do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    blob = F.concat(F.encode(F.concat(F.lit("blob "), F.col("length").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.col("content"))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha1(blob).alias("git_sha1"))


def compare_manifest(found: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem): entries that are missing, mismatched or extra against a manifest."""
    a = found.select(key, F.col(digest).alias("_found"))
    b = manifest.select(key, F.col(digest).alias("_want"))
    problem = F.when(F.col("_found").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_found") != F.col("_want"), "mismatched")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def tree_digest(hashes: DataFrame, by: list[str], key: str, digest: str) -> DataFrame:
    """(by.., files, sha256): one hash for each group of (key, digest), independent of order: the sum of the entries' hashes modulo 2^128.

    An order-free sum has map-side combining, where a hash of the sorted list would gather the whole group.
    """
    entry = F.sha2(F.concat_ws("\0", F.col(key).cast("string"), digest), 256)
    part = lambda i: F.sum(F.conv(F.substring(entry, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    sums = hashes.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), *(part(i).alias(f"p{i}") for i in range(4)))
    return sums.select(*by, "files", F.sha2(F.concat_ws("|", *(F.col(f"p{i}").cast("string") for i in range(4))), 256).alias("sha256"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; a line that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not yet in the Parquet table at path; how many. Safe to repeat after a failure, for one writer at a time."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = rows.select(key).limit(0)
    staged = new_folder(spark, "append")
    rows.dropDuplicates([key]).join(done, key, "left_anti").write.parquet(staged)
    todo = spark.read.schema(rows.schema).parquet(staged)
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n
