"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source get a rank in a seeded random order; a row's fractional rank (rank + 1/2) / rows of the source spreads every source
evenly over [0, 1). Sorted by it and cut into equal runs, each shard holds every source in proportion, to a row or two.
No sort runs in one task: ranks are sums of the counts of earlier buckets and the rank within a bucket, with the
buckets taken from the hash (within a source) and from the fractional rank (over all), both even by
construction. Buckets number about the root of the row count, so neither a bucket nor the list of buckets grows faster. Equal rows have equal
hashes; where they are many, a number of their own goes into the hash as well.

Law `rows`: shard sizes differ by one row at most. Defined cases: null text counts no bytes and has crc 0; a null source
is a source of its own; rows without a doc_id and repeated rows are dealt like others (among equal rows either may
take either place). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

SHARDS = 8
SEED = 20


def _earlier(counts: DataFrame, bucket: str, by: list[str]) -> DataFrame:
    """Add `first`, the rows of earlier buckets, to counts (by.., bucket, n)."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _told_apart(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows, written out, with `_twin`: a number of its own for each row that many rows are equal to, else 0.

    Rows that more than a root of the row count are equal to have fewer than that many different forms, 4096 at most, which are broadcast.
    """
    numbered = C.written(rows.withColumn("_key", F.xxhash64(*keys)).withColumn("_row", F.monotonically_increasing_id()))
    many = numbered.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > max(64, math.isqrt(n), n // 4096)).select("_key", F.lit(True).alias("_many"))
    return numbered.join(F.broadcast(many), "_key", "left").withColumn("_twin", F.when(F.col("_many"), F.col("_row")).otherwise(F.lit(0).cast("long"))).drop("_key", "_row", "_many")


def interleave(df: DataFrame, stratum: str, ties: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard and slot (gapless from 0) to each row. ties: columns that make the seeded order of rows definite."""
    n = df.count()
    if not n:
        return df.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    bits = max(0, math.ceil(math.log2(n / max(64, math.sqrt(n)))))
    rows = df.withColumn("_stratum", F.when(F.col(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string"))))
    rows = _told_apart(rows, ["_stratum", *ties], n).withColumn("_h", F.xxhash64(F.lit(seed), *ties, "_twin")).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    firsts = _earlier(rows.groupBy("_stratum", "_b").agg(F.count(F.lit(1)).alias("n")), "_b", ["_stratum"]).withColumn("of", F.sum("n").over(Window.partitionBy("_stratum"))).drop("n")
    within = Window.partitionBy("_stratum", "_b").orderBy("_h", *ties, "_twin")
    ranked = rows.withColumn("_r", F.row_number().over(within)).join(firsts, ["_stratum", "_b"])
    ranked = ranked.withColumn("_f", (F.col("first") + F.col("_r") - F.lit(0.5)) / F.col("of")).withColumn("_c", F.floor(F.col("_f") * (1 << bits))).drop("first", "of", "_r", "_b")
    counts = ranked.groupBy("_c").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket meets here: about the root of the row count.
    firsts = _earlier(counts, "_c", []).drop("n")
    within = Window.partitionBy("_c").orderBy("_f", "_stratum", "_h", *ties, "_twin")
    placed = ranked.withColumn("_r", F.row_number().over(within)).join(firsts, "_c").withColumn("_p", F.col("first") + F.col("_r") - 1)
    shard = F.expr(f"_p * {shards} div {n}L")
    start = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_p") - start).drop("_stratum", "_h", "_f", "_c", "_r", "_p", "first", "_twin")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size (bytes of the text and 1), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = interleave(rows, "source", ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(C.table(spark, sf_dir, "documents")).drop("source")
