import math

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import stats as S

_ROW = "world_id string, assignment string, instance int, rendering string, label string, category string, value string, tokens int"


def _planted(spark, renderings=("cedar", "json", "nl"), worlds=30, bad=8):
    """Every answer right, but for one rendering, which allows what is denied in the first worlds."""
    rows = []
    for w in range(worlds):
        for a in ("orig", "swap"):
            for q in range(4):
                label = "allow" if q < 2 else "deny"
                for r in renderings:
                    wrong = r == "nl" and label == "deny" and w < bad
                    rows.append((f"w{w:02}", a, q, r, label, "incorrect" if wrong else "correct", "allow" if wrong else label, 10))
    return spark.createDataFrame(rows, _ROW)


def test_a_planted_defect_gives_exact_rates(spark):
    rows = _planted(spark)
    worlds = M.per_world(rows, ["rendering"], M.answer_predicates())
    rates = {r["rendering"]: r for r in M.macro(worlds, ["rendering"], ["accuracy", "deny_to_allow", "allow_to_deny"]).collect()}
    assert math.isclose(rates["nl"]["deny_to_allow"], 8 / 30) and rates["nl"]["allow_to_deny"] == 0 and rates["cedar"]["accuracy"] == 1
    gap = M.paired_gap(worlds, "accuracy").agg(F.avg("diff"), F.first("best"), F.first("worst")).first()
    assert math.isclose(gap[0], 8 / 30 * 0.5) and (gap[1], gap[2]) == ("json", "nl")
    full = M.full_instances(rows, 3).groupBy("world_id").agg(F.avg("disagrees").alias("d")).agg(F.avg("d")).first()[0]
    assert math.isclose(full, 8 / 30 * 0.5)
    flips = {(r["a"], r["b"]): r["flips"] for r in M.pairwise_flips(rows).collect()}
    assert flips["cedar", "nl"] == 32 and flips["nl", "cedar"] == 0


def test_non_answers_are_no_errors_in_either_direction(spark):
    rows = _planted(spark, bad=0).withColumn("refuses", (F.col("world_id") == "w00") & (F.col("instance") == 0) & (F.col("rendering") == "json"))
    rows = rows.withColumn("category", F.when(F.col("refuses"), "refusal").otherwise(F.col("category"))).withColumn("value", F.when(F.col("refuses"), F.lit(None)).otherwise(F.col("value")))
    got = M.macro(M.per_world(rows, ["rendering"], M.answer_predicates()), ["rendering"], ["refusal", "allow_to_deny"]).where("rendering = 'json'").first()
    assert math.isclose(got["refusal"], 2 / 8 / 30) and got["allow_to_deny"] == 0


def test_votes_tie_only_at_the_top(spark):
    rows = [("w", "o", i, r, "allow", "correct" if v == "allow" else "incorrect" if v else "refusal", v, 5) for i, vs in enumerate([("allow", "deny", None), ("allow", "allow", "deny"), (None, None, None)]) for r, v in zip("abc", vs)]
    got = {r["instance"]: (r["value"], r["category"], r["tokens"]) for r in M.majority_vote(spark.createDataFrame(rows, _ROW)).collect()}
    assert got == {0: (None, "abstain", 15), 1: ("allow", "correct", 15), 2: (None, "abstain", 15)}
    assert M.majority_vote(spark.createDataFrame(rows, _ROW), "deny").where("instance = 2").first()["value"] == "deny"


def test_arms_must_have_the_same_cells(spark):
    rows = _planted(spark, worlds=2)
    assert M.unmatched(rows, rows, M.INSTANCE).isEmpty()
    assert M.unmatched(rows, rows.where("instance > 0"), M.INSTANCE).select("side").distinct().collect()[0][0] == "left"


def test_holm_and_false_discovery_rate(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    holm = {r["name"]: round(r["p_holm"], 12) for r in S.holm(tests, "p", ["name"]).collect()}
    assert holm == {"a": 0.03, "b": 0.06, "c": 0.06}
    more = tests.unionAll(spark.createDataFrame([("d", None)], "name string, p double"))
    q = {r["name"]: r["q"] for r in S.benjamini_hochberg(more, "p", ["name"]).collect()}
    assert math.isclose(q["a"], 0.03) and math.isclose(q["b"], 0.04) and math.isclose(q["c"], 0.04) and q["d"] is None


def test_weights_draw_as_many_as_there_are_units(spark):
    units = spark.createDataFrame([(f"w{i}",) for i in range(9)], "world_id string")
    got = S.weights(units, "world_id", 20, 1)
    assert {r["n"] for r in got.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()} == {9}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.weights(units.repartition(5), "world_id", 20, 1).collect()))


def test_rank_correlation_with_ties(spark):
    points = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 2.0), ("g", 3.0, 5.0), ("h", 1.0, 1.0), ("h", 2.0, 3.0), ("k", 1.0, 1.0), ("k", 2.0, 1.0), ("k", 3.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: r["rho"] for r in S.spearman(points, "x", "y", ["k"]).collect()}
    assert math.isclose(got["g"], 0.8660254037844387) and got["h"] is None and got["k"] is None


def test_exact_mcnemar(spark):
    got = [r[0] for r in spark.createDataFrame([(0, 0), (1, 8), (5, 5)], "b long, c long").select(S.exact_mcnemar(F.col("b"), F.col("c"))).collect()]
    assert got[0] == 1 and math.isclose(got[1], 2 * (1 + 9) / 2**9) and got[2] == 1
