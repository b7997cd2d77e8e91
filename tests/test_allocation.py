"""Balanced designs, quotas and draws against their definitions, under different partitionings."""

import collections
import hashlib
import itertools

from pyspark.sql import functions as F

from tessera.operators import allocation as A


def test_ranks_are_those_of_the_seeded_order(spark):
    rows = [(i, "big" if i % 3 else None) for i in range(700)]
    want = {}
    for g in ("big", None):
        own = sorted((hashlib.md5(f"5|{i}".encode()).hexdigest(), i) for i, x in rows if x == g)
        want |= {i: k for k, (_, i) in enumerate(own)}
    for parts, digits in ((1, 1), (7, 3)):
        df = spark.createDataFrame(rows, "id int, g string").repartition(parts)
        got = A.ranked(df, ["g"], A.seeded(5, F.col("id").cast("string")), digits=digits)
        assert {r["id"]: r["rank"] for r in got.collect()} == want


def test_every_marginal_and_pair_is_balanced(spark):
    factors = {"form": ["a", "b", "c"], "name": ["x", "y"], "side": ["l", "r"]}
    rows = [(i, f"g{i % 2}" if i < 240 else "odd") for i in range(257)]
    out = A.counterbalanced(spark.createDataFrame(rows, "id int, g string").repartition(5), ["g"], A.seeded(1, F.col("id").cast("string")), factors)
    found = out.collect()
    assert len(found) == len(rows) and out.columns == ["id", "g", *factors]
    for g, n in (("g0", 120), ("g1", 120), ("odd", 17)):
        cells = collections.Counter((r["form"], r["name"], r["side"]) for r in found if r["g"] == g)
        counts = [cells[c] for c in itertools.product(*factors.values())]
        assert sum(counts) == n and max(counts) - min(counts) == (n % 12 > 0)
    audit = {(r["g"], r["factor"]): (r["least"], r["most"]) for r in A.imbalance(out, ["g"], factors).collect()}
    assert len(audit) == 18 and audit["g0", "form"] == (40, 40) and audit["g1", "name x side"] == (30, 30) and all(b - a <= 3 for a, b in audit.values())
    few = A.counterbalanced(spark.createDataFrame(rows[:2], "id int, g string"), ["g"], A.seeded(1, F.col("id").cast("string")), factors)
    assert {r["least"] for r in A.imbalance(few, ["g"], factors).collect()} == {0}


def test_largest_remainders(spark):
    rows = [("p", "a", 5), ("p", "b", 3), ("p", "c", 1), ("q", "a", 1), ("q", "b", 1), ("q", "c", 1), ("z", "a", 0)]
    got = {(r["g"], r["s"]): r["quota"] for r in A.largest_remainder(spark.createDataFrame(rows, "g string, s string, w int"), ["g"], "s", "w", 10).collect()}
    assert got == {("p", "a"): 6, ("p", "b"): 3, ("p", "c"): 1, ("q", "a"): 4, ("q", "b"): 3, ("q", "c"): 3}


def _judge(df):
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("s"), "cell", F.col("attempt").cast("string"))), 1, 6), 16, 10).cast("bigint")
    return df.withColumn("h", h).withColumn("reason", F.when(F.col("cell") == "never", "closed").when(F.col("h") % 3 == 0, "low").when(F.col("h") % 3 == 1, "high"))


def test_draws_until_the_quota(spark):
    quotas = {"a": 1, "b": 4, "c": 0, "never": 2, "d": 9}
    want, report = {}, {}
    for c, q in quotas.items():
        kept, reasons, used = [], collections.Counter(), 0
        for k in range(60):
            if len(kept) == q:
                break
            h = int(hashlib.md5(f"s|{c}|{k}".encode()).hexdigest()[:6], 16)
            reason = "closed" if c == "never" else {0: "low", 1: "high", 2: None}[h % 3]
            kept, used = kept + [k] * (reason is None), used + 1
            reasons += collections.Counter([reason] if reason else [])
        want[c], report[c] = kept, (q, len(kept), used, len(kept) < q, dict(reasons))
    for parts, batch in ((1, 8), (5, 1)):
        cells = spark.createDataFrame(list(quotas.items()), "cell string, quota int").repartition(parts)
        accepted, told = A.draw_until(cells, _judge, 60, batch)
        got = collections.defaultdict(list)
        for r in accepted.collect():
            got[r["cell"]].append(r["attempt"])
        assert {c: sorted(got[c]) for c in quotas} == want
        assert {r["cell"]: (r["quota"], r["accepted"], r["attempts"], r["exhausted"], r["reasons"] or {}) for r in told.collect()} == report
