"""Matched texts: pairs that should be equal but for the lines of a treatment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.line_edits import line_edits


def compared(pairs: DataFrame, before: Column, after: Column, allowed: str) -> DataFrame:
    """pairs with edits, the numbers of lines kept, removed and added, and matched: whether every edit is a line that the pattern `allowed` finds.

    before and after are arrays of lines. A pair of equal texts is matched.
    """
    found = pairs.withColumn("edits", line_edits(before, after))
    by = lambda op: F.size(F.filter("edits", lambda e: e["op"] == op)).cast("long")
    out = found.withColumn("removed", by("-")).withColumn("added", by("+"))
    return out.withColumn("kept", F.size(F.coalesce(before, F.array().cast("array<string>"))).cast("long") - F.col("removed")).withColumn("matched", F.forall("edits", lambda e: F.regexp_like(e["line"], F.lit(allowed))))


def edits(pairs: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """(keys.., op, at, line): a row for each line that one text of a pair has and the other has not."""
    return pairs.select(*keys, F.inline(line_edits(before, after)))


def unmatched(examples: DataFrame, world: str, condition: str, base: str, text: str, allowed: str) -> DataFrame:
    """(world, condition, op, line): edits against the base condition's text of the same world that are no treatment, and worlds without a base (op and line null)."""
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    bases = examples.where(F.col(condition) == base).select(F.col(world).alias("_w"), F.col(text).alias("_base"))
    others = examples.where(F.col(condition) != base)
    both = others.join(bases, F.col(world) == F.col("_w"), "left")
    lost = both.where("_w is null").select(world, condition, F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("line"))
    found = edits(both.where("_w is not null"), [world, condition], lines(F.col("_base")), lines(F.col(text))).where(~F.regexp_like("line", F.lit(allowed)))
    return found.select(world, condition, "op", "line").unionAll(lost)
