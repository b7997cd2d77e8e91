"""Runs and releases as tables: which runs may be used, which sources may be passed on, and folders whose every file is hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import compare_manifest, file_hashes

#: What each model must state.
REQUIRED_KEYS = ("name", "revision", "params_b", "precision", "quantization")


def admission(runs: DataFrame, wanted: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(key, problem, found): why a wanted run may not be used; runs without a row may.

    runs: key, status, completed, total, and the columns `same`; wanted: key, total and the columns `same` as they should be. A run that is
    not there is missing; one that differs in several ways has a row for each. Nulls equal nulls.
    """
    a = runs.select(key, "status", "completed", F.col("total").alias("_total"), *(F.col(c).alias(f"_{c}") for c in same), F.lit(True).alias("_there"))
    both = wanted.select(key, F.col("total").alias("_want"), *same).join(a, key, "left")
    row = lambda bad, problem, found: F.when(bad, F.struct(F.lit(problem).alias("problem"), found.cast("string").alias("found")))
    open_ = ~(F.col("status").eqNullSafe("complete") & F.col("completed").eqNullSafe(F.col("_total")))
    there = F.col("_there").isNotNull()
    state = F.concat_ws(" ", F.coalesce("status", F.lit("?")), F.concat_ws("/", F.coalesce(F.col("completed").cast("string"), F.lit("?")), F.coalesce(F.col("_total").cast("string"), F.lit("?"))))
    checks = [row(~there, "missing", F.lit(None)), row(there & open_, "not complete", state), row(there & ~F.col("_total").eqNullSafe(F.col("_want")), "rows", F.col("_total")), *(row(there & ~F.col(c).eqNullSafe(F.col(f"_{c}")), c, F.col(f"_{c}")) for c in same)]
    return both.select(key, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(key, "x.*")


def admitted(rows: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """The rows of runs that have no problem."""
    return rows.join(problems.select(key).distinct(), key, "left_anti")


def registry_problems(models: DataFrame, members: DataFrame) -> DataFrame:
    """(name, problem): models that lack a required key, and members of sets (set, model) that are no models."""
    lacking = models.select(F.col("model").alias("name"), F.explode(F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.lit(f"no {k}")) for k in REQUIRED_KEYS)))).alias("problem"))
    unknown = members.join(models.select("model").distinct(), "model", "left_anti").select(F.col("model").alias("name"), F.concat(F.lit("unknown in "), F.col("set")).alias("problem"))
    return lacking.unionAll(unknown)


def license_problems(used: DataFrame, licenses: DataFrame, compatible: list[str]) -> DataFrame:
    """(source, license, rows): sources in use (used: one row per use) without a license that the release's is compatible with."""
    counts = used.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    both = counts.join(licenses.select("source", "license"), "source", "left")
    return both.where(~F.coalesce(F.col("license").isin(*compatible), F.lit(False))).select("source", "license", "rows")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One object per line, keys in order of name, nulls stated."""
    rows.select(*sorted(rows.columns)).write.option("ignoreNullFields", "false").json(path)


def write_json_object(spark: SparkSession, values: dict[str, Column], path: str) -> None:
    """One row, such as a run's status, as a folder of a single object."""
    write_json_lines(spark.range(1).select(*(c.alias(n) for n, c in values.items())), path)


def folder_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files below a folder, named from there, whatever folders below it are called."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    # Files are named with scheme and authority; what lies below the folder begins behind its own path, where that first stands.
    below = F.substring("path", F.position(F.lit(f"{whole}/"), "path") + len(whole) + 1, F.length("path"))
    return file_hashes(spark, path).select(below.alias("file"), "bytes", "sha256")


def write_release(tables: dict[str, DataFrame], path: str, form: str = "json") -> None:
    """Each table below path/data, then the hashes of its files in path/manifest (see `storage.file_hashes`: no empty or hidden files, and none over 2 GB). A release cut short has no manifest, so it does not verify."""
    for name, rows in tables.items():
        if form == "json":
            write_json_lines(rows, f"{path}/data/{name}")
        else:
            rows.write.format(form).save(f"{path}/data/{name}")
    spark = next(iter(tables.values())).sparkSession
    folder_hashes(spark, f"{path}/data").write.json(f"{path}/manifest")


def verify_release(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem): files that are missing, mismatched or extra; empty for a release as it was written."""
    manifest = spark.read.schema("file string, bytes bigint, sha256 string").option("mode", "FAILFAST").json(f"{path}/manifest")
    return compare_manifest(folder_hashes(spark, f"{path}/data"), manifest, "file", "sha256")


def read_release(spark: SparkSession, path: str, name: str, schema: str, form: str = "json") -> DataFrame:
    """A table of a release, after every file has been checked."""
    bad = verify_release(spark, path)
    if not bad.isEmpty():
        raise ValueError(f"{path} does not verify: {[tuple(r) for r in bad.limit(5).collect()]}")
    reader = spark.read.schema(schema)
    return (reader.option("mode", "FAILFAST") if form == "json" else reader).format(form).load(f"{path}/data/{name}")
