"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is written as a run: a row per document of (digest, check, size, id), sorted by digest, where digest is a 64-bit hash
of the normalised text and check and size, its SHA-256 and its length in bytes, verify it. Runs then merge in binomial rounds: run r meets the
runs that share r >> FAN_BITS, up to 2**FAN_BITS of them at once, and of each verified text one row goes on, with the identifier to stay and the number
of copies. A round's rows are dealt out by (merged run, digest), so a round is spread over all tasks and a text brings at most one row
a run, however many copies it has. The last round has one run. What it says of texts with copies goes back down the same tree, a level a
join, to the runs it came from; rows of texts without copies need no answer. Every level is written to the shared folder. Texts are read once and never shuffled.

Defined cases: null counts as empty. Texts are equal when equal after lower-casing A-Z only. Of equal rows of one id, any one stays (exactly one);
a row without an id stays only if none of its group has one. An empty table gives an empty result. Extra columns of whatever name
are ignored by `exact_groups` and kept by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Runs that merge at once: 2 to this power.
FAN_BITS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["digest", "check", "size"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def digest_runs(rows: DataFrame, digest_bits: int = 64) -> DataFrame:
    """(run, row, id, digest, check, size) of rows (row, id, text), written; each partition is a run sorted by digest. digest_bits: fewer make digests that collide."""
    text = rows.select(F.spark_partition_id().alias("run"), "row", "id", normalised(F.col("text")).alias("t"))
    digest = F.shiftrightunsigned(F.xxhash64("t"), 64 - digest_bits)
    runs = text.select("run", "row", "id", digest.alias("digest"), F.unhex(F.sha2("t", 256)).alias("check"), F.octet_length("t").cast("long").alias("size"))
    return C.written(runs.sortWithinPartitions("digest", "check"))


def _merged(rows: DataFrame, run: Column, best: Column, n: Column) -> DataFrame:
    """One row of each verified text of each run."""
    return C.written(rows.groupBy(run.alias("run"), *_KEY).agg(best.alias("best"), n.alias("n")))


def tree_merge(runs: DataFrame, keep: str = "smallest", fan_bits: int = FAN_BITS) -> DataFrame:
    """(run, digest, check, size, best, n) of each text with copies, for each run that holds it: best has the id and row that stay, n counts the copies of all runs."""
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    first, pick = (F.struct(F.isnull("id").alias("last"), "id", "row"), F.min) if keep == "smallest" else (F.struct(F.isnotnull("id").alias("last"), "id", "row"), F.max)
    levels = [_merged(runs, F.col("run"), pick(first), F.count(F.lit(1)))]
    most = levels[0].agg(F.max("run")).first()[0] or 0
    while most:
        levels.append(_merged(levels[-1], F.shiftright("run", fan_bits), pick("best"), F.sum("n")))
        most >>= fan_bits
    known = levels[-1].where("n > 1")
    for level in reversed(levels[:-1]):
        known = level.select(F.shiftright("run", fan_bits).alias("into"), F.col("run").alias("from"), *_KEY).join(known.withColumnRenamed("run", "into"), ["into", *_KEY])
        known = known.drop("into").withColumnRenamed("from", "run")
    return known


def _answered(runs: DataFrame, keep: str, fan_bits: int) -> DataFrame:
    """(row, id, keep_id, group_size, kept, text_sha256) of each row of the runs."""
    answers = tree_merge(runs, keep, fan_bits)
    both = runs.join(answers, ["run", *_KEY], "left")
    alone = F.isnull("n")
    return both.select(
        "row",
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("check")).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, keep: str = "smallest", fan_bits: int = FAN_BITS, digest_bits: int = 64) -> DataFrame:
    """Per row: doc_id, keep_id (the id that stays), group_size, kept, text_sha256 (of the normalised text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text")
    return _answered(digest_runs(rows, digest_bits), keep, fan_bits).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest", fan_bits: int = FAN_BITS) -> DataFrame:
    """docs without the rows that are copies of another; all columns as they came."""
    row = C.fresh(docs, "row")
    numbered = C.written(docs.withColumn(row, F.monotonically_increasing_id()))
    runs = digest_runs(numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text"))
    gone = _answered(runs, keep, fan_bits).where("not kept").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*C.columns(docs))


def op12_tree_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(C.table(spark, sf_dir, "documents"), keep="largest")
