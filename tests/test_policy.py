from tessera import schemas as S
from tessera.operators import policy as P


def _request(action, principal, groups, size, quantity):
    attrs = {"level": S.value(size)}
    return ("p", action, (principal, principal.split("::")[0], [*groups, principal], {}), ("doc::1", "doc", ["doc::1"], attrs), {"quantity": S.value(quantity), "mfa": S.value(True)})


_SUBJECT = f"struct<key:string,type:string,groups:array<string>,attrs:map<string,{S.VALUE}>>"
_REQUESTS = f"policy_id string, action string, principal {_SUBJECT}, resource {_SUBJECT}, context map<string,{S.VALUE}>"


def _decide(spark, rules, *requests):
    rules = spark.createDataFrame([("p", r) for r in rules], S.RULES)
    got = P.evaluate(spark.createDataFrame(list(requests), _REQUESTS), rules)
    return [(r["decision"], r["governing"], r["permits"], r["forbids"]) for r in got.select("decision", "governing", "permits", "forbids").collect()]


def test_a_forbid_overrides_and_nothing_denies(spark):
    rules = [S.rule("a", "permit", S.in_scope("group", "g"), ["read"], S.any_scope()), S.rule("b", "forbid", S.any_scope(), ["read"], S.is_scope("doc"), (S.attr("context", "quantity"), ">=", S.literal(5)))]
    got = _decide(spark, rules, _request("read", "user::1", ["group::g"], 1, 4), _request("read", "user::1", ["group::g"], 1, 5), _request("read", "user::2", [], 1, 1), _request("write", "user::1", ["group::g"], 1, 1))
    assert got == [("allow", "permit", ["a"], []), ("deny", "forbid", ["a"], ["b"]), ("deny", "scope", [], []), ("deny", "scope", [], [])]


def test_membership_scopes_are_reflexive_and_typed(spark):
    rules = [S.rule("a", "permit", S.in_scope("group", "g"), ["read"], S.any_scope()), S.rule("b", "permit", S.in_scope("group", "g", "user"), ["write"], S.any_scope())]
    got = _decide(spark, rules, _request("read", "group::g", [], 1, 1), _request("write", "group::g", [], 1, 1), _request("write", "user::9", ["group::g"], 1, 1))
    assert [g[0] for g in got] == ["allow", "deny", "allow"]


def test_values_of_different_types_are_unequal_and_only_integers_are_ordered(spark):
    mfa = lambda op, x: [S.rule("a", "permit", S.any_scope(), ["read"], S.any_scope(), (S.attr("context", "mfa"), op, S.literal(x)))]
    one = _request("read", "user::1", [], 1, 1)
    assert _decide(spark, mfa("==", True), one)[0][0] == "allow"
    assert _decide(spark, mfa("==", 1), one)[0][:2] == ("deny", "condition")
    assert _decide(spark, mfa("!=", 1), one)[0][0] == "allow"
    assert _decide(spark, mfa("<", 2), one)[0][0] == "deny"


def test_closure_reaches_through_and_marks_cycles(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "x", "y"), ("p", "y", "x"), ("q", "c", "d")], "policy_id string, key string, parent string")
    got = {(r["policy_id"], r["key"], r["ancestor"]) for r in P.closure(edges).collect()}
    assert got == {("p", "a", "b"), ("p", "a", "c"), ("p", "b", "c"), ("p", "x", "y"), ("p", "x", "x"), ("p", "y", "x"), ("p", "y", "y"), ("q", "c", "d")}


def test_closure_of_a_long_chain_and_a_long_cycle(spark):
    edges = [("p", f"n{i}", f"n{i + 1}") for i in range(1000)] + [("q", f"c{i}", f"c{(i + 1) % 70}") for i in range(70)]
    found = P.closure(spark.createDataFrame(edges, "policy_id string, key string, parent string"))
    assert {r["policy_id"]: r["count"] for r in found.groupBy("policy_id").count().collect()} == {"p": 1000 * 1001 // 2, "q": 4900}
    assert found.where("key = 'n0' and ancestor = 'n1000'").count() == 1 and found.where("key = ancestor").count() == 70


def test_boundary_is_a_flip_along_one_axis(spark):
    rows = [(x, y, "allow" if x >= 2 and y >= 1 else "deny") for x in range(4) for y in range(3)]
    got = {(r["x"], r["y"]) for r in P.boundary(spark.createDataFrame([("p", *r) for r in rows], "p string, x int, y int, decision string"), ["p"], ["x", "y"]).where("boundary").collect()}
    decide = {(x, y): d for x, y, d in rows}
    want = {(x, y) for x, y in decide if any(decide[i, y] != decide[x, y] for i in range(4)) or any(decide[x, j] != decide[x, y] for j in range(3))}
    assert got == want


def test_rotation_takes_the_next_name(spark):
    got = {(r["t"], r["n"]): r["renamed"] for r in P.rotation(spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "q")], "t string, n string"), ["t"], "n").collect()}
    assert got == {("a", "x"): "y", ("a", "y"): "z", ("a", "z"): "x", ("b", "q"): "q"}


def test_rotation_of_a_group_over_many_ranges(spark):
    rows = [("a", f"{i:05d}") for i in range(2000)] + [("b", "x"), ("b", "x"), (None, "y"), (None, "z")]
    got = {(r["t"], r["n"]): r["renamed"] for r in P.rotation(spark.createDataFrame(rows, "t string, n string").repartition(8), ["t"], "n").collect()}
    assert got == {("a", f"{i:05d}"): f"{(i + 1) % 2000:05d}" for i in range(2000)} | {("b", "x"): "x", (None, "y"): "z", (None, "z"): "y"}


def test_an_empty_owner_set_is_an_answer(spark):
    rows = spark.createDataFrame([("d", "deny", "u1"), ("e", "allow", "u2"), ("e", "allow", "u1")], "doc string, decision string, who string")
    from pyspark.sql import functions as F

    assert {(r["doc"], r["principal"]) for r in P.owners(rows, ["doc"], F.col("who")).collect()} == {("e", "u1"), ("e", "u2")}
    assert {r["doc"]: (r["n_owners"], r["digest"] > 0) for r in P.owner_sets(rows, ["doc"], F.col("who")).collect()} == {"d": (0, False), "e": (2, True)}


def test_universe_refuses_what_is_too_large(spark):
    import pytest

    one = lambda c, n: spark.createDataFrame([("p", i) for i in range(n)], f"policy_id string, {c} int")
    assert P.universe(one("a", 3), one("b", 2), one("c", 2), one("d", 1)).count() == 12
    with pytest.raises(ValueError):
        P.universe(one("a", 30), one("b", 20), one("c", 2), one("d", 1), limit=1000)
