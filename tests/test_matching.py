"""Edits between texts against the usual table of common subsequences, and matched prompts with and without a fault."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.line_edits import edits_between, line_edits
from tessera.operators import matching as M


def _common(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(row[i] + 1 if x == y else max(row[i + 1], new[-1]))
        row = new
    return row[-1]


def _applied(a, edits):
    gone = {i for o, i, _ in edits if o == "-"}
    kept = iter(x for i, x in enumerate(a) if i not in gone)
    added = {i: t for o, i, t in edits if o == "+"}
    n = len(a) - len(gone) + len(added)
    return [added[i] if i in added else next(kept) for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_edits_are_shortest_and_lead_there(a, b):
    edits = edits_between(a, b)
    assert _applied(a, edits) == b and all(a[i] == t for o, i, t in edits if o == "-")
    n = _common(a, b)
    assert (sum(o == "-" for o, *_ in edits), sum(o == "+" for o, *_ in edits)) == (len(a) - n, len(b) - n)


def test_edits_of_columns(spark):
    r = random.Random(1)
    rows = [(i, *([r.choice("xyz") for _ in range(r.randint(0, 200))] for _ in range(2))) for i in range(20)] + [(90, None, ["p"]), (91, [], None), (92, ["é\n"], ["é\n", ""])]
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>").repartition(3)
    got = {x["k"]: [tuple(e) for e in x["e"]] for x in df.select("k", line_edits(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {k: edits_between(a or [], b or []) for k, a, b in rows} and got[90] == [("+", 0, "p")] and got[92] == [("+", 1, "")]


def test_matched_prompts(spark):
    base = "Task\nFacts: a\nGrant: none\nAnswer:"
    rows = [("w1", "none", base), ("w1", "full", base.replace("none", "all")), ("w1", "some", base.replace("Grant: none", "Grant: x\nGrant: y")), ("w2", "none", base), ("w2", "full", base.replace("none", "all").replace("a\n", "b\n")), ("w3", "full", base), ("w4", "none", None), ("w4", "full", "Grant: all")]
    examples = spark.createDataFrame(rows, "world string, condition string, prompt string")
    got = {tuple(r) for r in M.unmatched(examples, "world", "condition", "none", "prompt", "^(Grant: |$)").collect()}
    assert got == {("w2", "full", "-", "Facts: a"), ("w2", "full", "+", "Facts: b"), ("w3", "full", None, None)}
    pair = spark.createDataFrame([(["a", "b"], ["a", "G", "b"]), (["a"], ["b"]), ([], [])], "x array<string>, y array<string>")
    assert [(r["kept"], r["removed"], r["added"], r["matched"]) for r in M.compared(pair, F.col("x"), F.col("y"), "^G").collect()] == [(2, 0, 1, True), (0, 1, 1, False), (0, 0, 0, True)]
