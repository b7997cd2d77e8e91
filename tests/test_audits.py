from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators import audits as A
from tessera.operators import stats


def test_matched_groups(spark):
    rows = [("p", "a", 1), ("p", "b", 1), ("q", "a", 1), ("q", "a", 2), ("r", "a", 1), ("r", "b", None), ("s", "a", None), ("s", "b", None)]
    found = A.matched_groups(spark.createDataFrame(rows, "g string, c string, x int"), "g", "c", ["a", "b"], {"x": F.col("x")})
    assert {tuple(r) for r in found.collect()} == {("q", "missing", "b"), ("q", "repeated", "a"), ("q", "varies", "x"), ("r", "varies", "x")}


def test_role_swaps(spark):
    rows = [(1, "s", "q", "c", "e"), (1, "u", "q", "e", "c"), (2, "s", "q", "c", "e"), (2, "u", "q", "c", "e"), (3, "s", "q", "c", "e"), (4, "s", "q", "c", "e"), (4, "u", "z", "e", "c")]
    found = A.role_swaps(spark.createDataFrame(rows, "p int, r string, q string, x string, y string"), "p", "r", "s", "u", ["q"], ("x", "y"))
    assert {tuple(r) for r in found.collect()} == {(2, "places not swapped"), (3, "missing role"), (4, "content differs")}


def test_independence_of_a_constant_is_zero(spark):
    rows = spark.createDataFrame([(float(i), float(-i), 1.0) for i in range(5)], "a double, b double, c double")
    got = {(r["a"], r["b"]): (round(r["r"], 9), r["passed"]) for r in A.independence(rows, ["a", "b", "c"], 0.2).collect()}
    assert got == {("a", "b"): (-1.0, False), ("a", "c"): (0.0, True), ("b", "c"): (0.0, True)}


def test_learning_rate_and_log_probabilities(spark):
    import math

    got = [r[0] for r in spark.range(12).select(A.learning_rate(F.col("id"), 10, 2, 1.0)).collect()]
    assert [round(x, 9) for x in got] == [round(x, 9) for x in [0.5, 1.0, *(0.5 * (1 + math.cos(math.pi * min(1, (s - 2) / 8))) for s in range(2, 12))]]
    row = spark.createDataFrame([([[0.0, 1.0], [2.0, 0.0], [5.0, 5.0]], [0, 1, 0]), ([[0.0]], [0])], "x array<array<double>>, t array<int>")
    lp = [r[0] for r in row.select(A.sum_logprob(F.col("x"), F.col("t"))).collect()]
    want = 1 - math.log(1 + math.e) + 2 - math.log(math.e**2 + 1)
    assert abs(lp[0] - want) < 1e-9 and lp[1] is None


def test_semantic_hash_ignores_ids_and_order(spark):
    a, b = S.rule("r1", "permit", S.any_scope(), ["x", "y"], S.any_scope()), S.rule("r2", "forbid", S.is_scope("u"), ["x"], S.any_scope(), (S.attr("context", "k"), "==", S.literal(1)))
    other = S.rule("z", "forbid", S.is_scope("u"), ["x"], S.any_scope(), (S.attr("context", "k"), "==", S.literal(True)))
    renamed = ("q", "permit", S.any_scope(), ["y", "x"], S.any_scope(), [])
    rules = spark.createDataFrame([("p", a), ("p", b), ("q", b), ("q", renamed), ("r", a), ("r", other)], S.RULES)
    entities = spark.createDataFrame([(p, "u::1", "u") for p in "pqr"], "policy_id string, key string, type string")
    got = {r["policy_id"]: r["sha256"] for r in A.semantic_hash(rules, entities).collect()}
    assert got["p"] == got["q"] != got["r"]


def test_bootstrap_of_balanced_accuracy(spark):
    import numpy as np

    rows = spark.createDataFrame([(f"w{i % 7}", i % 2, (i % 2) if i % 5 else 1 - i % 2) for i in range(70)], "w string, y int, z int")
    means = [r["mean"] for r in A.bootstrap_balanced_accuracy(rows, "y", "z", stats.weights(rows, "w", 50, 1), "w").collect()]
    assert len(means) == 50 and abs(np.mean(means) - 0.8) < 0.05


def test_exact_mcnemar_of_large_counts(spark):
    df = spark.createDataFrame([(50_000_000, 50_000_000), (50_010_000, 49_990_000), (3, 1)], "b long, c long")
    got = [r[0] for r in df.select(stats.exact_mcnemar(F.col("b"), F.col("c"))).collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.0455) < 0.0005 and abs(got[2] - 0.625) < 1e-12
