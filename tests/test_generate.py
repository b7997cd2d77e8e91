from tessera.operators import generate as G
from tessera.operators import policy as P


def test_draws_are_the_same_anywhere_and_well_formed(spark):
    ids = spark.createDataFrame([(f"p{i}",) for i in range(40)], "policy_id string")
    draw = lambda df, seed=3: G.draw_rules(df, ["g", "h"], ["a", "b", "c"], "user", "doc", "size", 9, seed)
    got = sorted(str(r) for r in draw(ids).collect())
    assert got == sorted(str(r) for r in draw(ids.repartition(7)).collect()) != sorted(str(r) for r in draw(ids, 4).collect())
    rules = draw(ids)
    assert {r["policy_id"] for r in rules.collect()} == {f"p{i}" for i in range(40)}
    assert {r["e"] for r in rules.selectExpr("rule.effect as e").collect()} == {"permit", "forbid"}
    assert all(1 <= len(r["a"]) <= 2 for r in rules.selectExpr("rule.actions as a").collect()) and {r["n"] for r in rules.selectExpr("size(rule.conditions) as n").collect()} == {0, 1}
    wrong = P.violations(spark.createDataFrame([(f"p{i}", f"group::{g}", "group") for i in range(40) for g in "gh"], "policy_id string, key string, type string"), spark.createDataFrame([], "policy_id string, key string, parent string"), spark.createDataFrame([], "policy_id string, key string, type string, attr string, value_type string"), rules)
    assert wrong.count() == 0


def test_the_bar(spark):
    rows = [("few", "allow", True, ["r0"], [])] * 2 + [("few", "deny", True, [], [])] * 9
    rows += [("flat", "allow", False, ["r0"], [])] * 6 + [("flat", "deny", False, [], [])] * 6
    rows += [("dead", "allow", True, ["r0", "r1"], [])] * 6 + [("dead", "deny", True, [], [])] * 6
    rows += [("good", "allow", True, ["r0"], [])] * 6 + [("good", "deny", True, ["r0"], ["r1"])] * 6
    decided = spark.createDataFrame(rows, "policy_id string, decision string, boundary boolean, permits array<string>, forbids array<string>")
    rules = spark.createDataFrame([(p, r) for p in ("few", "flat", "dead", "good") for r in ("r0", "r1")], "policy_id string, rule_id string")
    got = {r["policy_id"]: r["reason"] for r in G.keep_reason(decided, rules, 4).collect()}
    assert got == {"few": "too few allowed", "flat": "too few on the boundary", "dead": "dead rule", "good": "ok"}
