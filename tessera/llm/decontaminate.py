"""Benchmark decontamination by a broadcast hash set of normalised n-grams, in DataFrame operations only.

Words are runs of characters outside ASCII punctuation, space and control characters, with A-Z lower-cased. The windows of
`n` consecutive words of the benchmark items (an item of fewer words is one window) form a set of 64-bit hashes, broadcast
while it counts at most `BROADCAST_WINDOWS` windows and joined by shuffle beyond. Every window of every document is looked up there; the
few that are found are compared word by word before they count. Texts are read once for all window lengths, with each word hashed once. Found windows travel to their document
in one join on (doc_id, a hash of the text), so a text is moved once; which items they belong to is looked up for the windows that hold.

Defined cases: null or empty texts have no words and are never contaminated; items without words are ignored; an item without an
item_id contaminates but is not listed. Rows without a doc_id and repeated rows are judged by their text like all others.
An empty benchmark leaves all documents clean. Extra columns, of whatever name, are ignored by `contamination` and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

N = 10
#: Windows (8-byte hashes) up to which the set is broadcast: some tens of MB.
BROADCAST_WINDOWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same with capitals as letters, for texts as they are.
_GAP_ANY_CASE, _LETTERS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _GAP), "")


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def windows_of(items: DataFrame, n: int = N) -> DataFrame:
    """(size, h, gram, item_id): the windows of each item, distinct."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    starts = own.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    gram = starts.select("item_id", "size", F.slice("w", F.col("i"), F.col("size")).alias("gram"))
    return gram.select("size", F.xxhash64(_word_hashes(F.col("gram"))).alias("h"), "gram", "item_id").distinct()


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, th, hits): of each text with found windows, their places and words. Hash agreement only so far."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # N at most
    grams = windows.select("size", "h", "gram").distinct()
    known = windows.select("size", "h").distinct()
    if known.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    text = docs.select("doc_id", F.xxhash64("text").alias("th"), _word_hashes(words(F.col("text"))).alias("w"))
    each = text.withColumn("size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))).where(F.size("w") >= F.col("size"))
    # `transform` hands out the 1-based place through the sequence, so that only hashes leave the row.
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("size"))))
    found = each.select("doc_id", "th", "size", F.posexplode(hashes).alias("at", "h")).join(known, ["size", "h"], "left_semi")
    return found.join(grams, ["size", "h"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "gram")).alias("hits"))


def _judged(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs with _th (a hash of the text), _n_words, _places (1-based hit words) and _grams (the distinct windows found)."""
    hits = _hits(docs.where("text is not null").select("doc_id", "text"), windows)
    hits = hits.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_h"), F.col("hits").alias("_hits"))
    both = docs.withColumn("_th", F.xxhash64("text")).join(hits, F.expr("doc_id <=> _doc and _th = _h"), "left")
    found = F.filter("_hits", lambda x: F.slice("_w", x["at"] + 1, F.size(x["gram"])) == x["gram"])
    none = F.array().cast("array<int>")
    both = both.withColumn("_w", words(F.col("text"))).withColumn("_n_words", F.size("_w").cast("long"))
    both = both.withColumn("_true", F.when(F.col("_hits").isNotNull(), found)).drop("_hits", "_doc", "_h", "_w")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("_true", lambda x: F.sequence(x["at"] + 1, x["at"] + F.size(x["gram"]))))))
    grams = F.array_distinct(F.transform("_true", lambda x: x["gram"]))
    return both.withColumn("_places", F.coalesce(places, none)).withColumn("_grams", F.coalesce(grams, F.array().cast("array<array<string>>"))).drop("_true")


def contamination(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), places (1-based hit words), contaminated."""
    windows = windows_of(items, n)
    found = C.written(_judged(docs.select("doc_id", "text"), windows).select("doc_id", F.col("_th").alias("th"), F.col("_n_words").alias("n_words"), F.col("_places").alias("places"), F.col("_grams").alias("grams")))
    met = found.select("doc_id", "th", F.explode("grams").alias("gram")).distinct().withColumn("size", F.size("gram")).withColumn("h", F.xxhash64(_word_hashes(F.col("gram"))))
    owned = met.join(windows, ["size", "h", "gram"]).where("item_id is not null").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    owned = owned.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_h"), "items")
    both = found.join(owned, F.expr("doc_id <=> _doc and th = _h"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.size("places").cast("long")
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "places", (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """docs without contaminated rows (remove='documents'), or with the hit words and the gaps after them cut out (remove='spans')."""
    own = ("doc_id", "text")
    found = _judged(C.carried(docs, *own), windows_of(items, n))
    if remove == "documents":
        return found.where(F.size("_places") == 0).select(*C.restored(found, docs.columns, *own))
    gaps = F.split("text", _LETTERS_ANY_CASE)
    kept = F.array_remove(F.split("text", _GAP_ANY_CASE), "")
    rest = F.array_except(F.when(F.size(kept) > 0, F.sequence(F.lit(1), F.size(kept))).otherwise(F.array().cast("array<int>")), "_places")
    pieces = F.transform(rest, lambda i: F.concat(F.get(kept, i - 1), F.coalesce(F.get(gaps, i), F.lit(""))))
    cut = F.concat(F.coalesce(F.get(gaps, F.lit(0)), F.lit("")), F.array_join(pieces, ""))
    return found.withColumn("text", F.when(F.size("_places") > 0, cut).otherwise(F.col("text"))).select(*C.restored(found, docs.columns, *own))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
