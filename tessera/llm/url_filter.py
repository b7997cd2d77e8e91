"""URL filters with a history: dated list entries become validity intervals, and captures meet the entries active at fetch time.

An entry names a list, a kind of pattern (domain, host or prefix of host and path), the pattern, an action (add or remove)
and the day it takes effect. Entries of one list and pattern, in order of day, make intervals [valid_from, valid_to) in which the
pattern is listed. A capture offers the patterns that could match it (its host's parent domains of two labels or more, its host, every leading
part of its path): an equi-join on the pattern with a range condition on the day is the as-of join, whose hot
keys Spark can split. The most specific active entry decides, then the longer pattern, then the list's name.

Defined cases: a null url, a url without a host or a null day matches nothing. Of entries of one list, pattern and day, removals win.
Entries with a null in any field are ignored; removing what is not listed and adding what is listed change
nothing. Captures that repeat are judged row by row if their ids differ, and share a verdict if not. Patterns are
compared in lower case for hosts, as written for paths.
Extra columns are ignored; an empty table of pages gives an empty result, and without entries nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: More specific kinds decide first.
KINDS = {"domain": 1, "host": 2, "prefix": 3}


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) of dated entries (list, kind, pattern, action, day); an open end is null."""
    daily = entries.dropna(subset=["list", "kind", "pattern", "action", "day"]).groupBy("list", "kind", "pattern", "day").agg((F.max(F.when(F.col("action") == "remove", 1).otherwise(0)) == 0).alias("listed"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    turns = daily.withColumn("was", F.coalesce(F.lag("listed").over(w), F.lit(False))).where("listed != was")
    return turns.withColumn("valid_to", F.lead("day").over(w)).where("listed").select("list", "kind", "pattern", F.col("day").alias("valid_from"), "valid_to")


def url_patterns(captures: DataFrame, key: str, url: str, day: str) -> DataFrame:
    """(key, day, kind, pattern): what could match each capture."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    own = captures.select(F.col(key).alias("key"), F.col(day).alias("day"), host.alias("host"), F.regexp_extract(url, _PATH, 1).alias("path")).where("host != '' and day is not null").distinct()
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    domains = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(labels))), lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -n, n), ".").alias("pattern")))
    domains = F.when(F.size(labels) >= 2, domains).otherwise(F.slice(domains, 1, 0))
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda n: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(parts, 1, n), "/")).alias("pattern")))
    prefixes = F.when(F.size(parts) >= 2, prefixes).otherwise(F.slice(prefixes, 1, 0))
    hosts = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")))
    return own.select("key", "day", F.explode(F.concat(domains, hosts, prefixes)).alias("p")).select("key", "day", "p.kind", "p.pattern")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "fetched") -> DataFrame:
    """Per distinct (key, day): key, day, n_active entries, lists (sorted, comma-joined), decided_by (list) and pattern; blocked unless it is `allow`."""
    spans = validity_intervals(entries)
    met = url_patterns(captures, key, url, day).join(spans, ["kind", "pattern"]).where("valid_from <= day and (valid_to is null or day < valid_to)")
    rank = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("kind")]
    # Least first: specific kinds and long patterns are negated.
    order = F.struct((-rank).alias("r"), (-F.length("pattern")).alias("l"), "list", "pattern")
    verdict = met.groupBy("key", "day").agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min(order).alias("first"))
    everyone = captures.select(F.col(key).alias("key"), F.col(day).alias("day"))
    both = everyone.alias("c").join(verdict.alias("v"), F.expr("c.key <=> v.key and c.day <=> v.day"), "left")
    return both.select(
        F.col("c.key").alias(key), F.col("c.day").alias(day), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("first.list").alias("decided_by"), F.col("first.pattern").alias("pattern"), F.coalesce(F.col("first.list") != "allow", F.lit(False)).alias("blocked"),
    )


def _number(text) -> object:
    """28 bits of a column's md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 7), 16, 10).cast("long")


def list_history(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts, domains and first path parts of the pages themselves, by hash: additions, removals, additions again."""
    own = pages.select(F.lower(F.regexp_extract("url", _HOST, 1)).alias("host"), F.regexp_extract("url", _PATH, 1).alias("path")).where("host != ''")
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    options = F.array(
        F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)), ".").alias("pattern")),
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")),
        F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(parts, 1, 2), "/")).alias("pattern")),
    )
    known = own.select(F.explode(options).alias("p")).select("p.kind", "p.pattern").distinct()
    listed = known.select("kind", "pattern", F.explode(F.array(*(F.lit(x) for x in ("allow", "malware", "spam")))).alias("list"))
    seeded = listed.withColumn("x", _number(F.concat_ws("|", "list", "kind", "pattern"))).where("x % 5 < 2")
    turns = F.array(
        F.struct(F.lit("add").alias("action"), (F.col("x") % 700).alias("d")),
        F.struct(F.lit("remove").alias("action"), (F.col("x") % 700 + 30 + F.col("x") % 400).alias("d")),
        F.struct(F.lit("add").alias("action"), (F.col("x") % 700 + 500 + F.col("x") % 600).alias("d")),
    )
    dated = seeded.withColumn("turn", F.explode(turns))
    return dated.select("list", "kind", "pattern", "turn.action", F.date_add(F.lit("2020-01-01").cast("date"), F.col("turn.d").cast("int")).alias("day"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2020-01-01").cast("date"), (_number(F.col("page_id")) % 1461).cast("int")))
    return judge(captures, list_history(pages))
