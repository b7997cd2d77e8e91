from tessera.operators import trials as T
from tessera.operators import vectors as V
from pyspark.sql import functions as F


def test_pairs_of_one_side_are_not_complete(spark):
    rows = [(1, "a", 1.0), (1, "b", -0.5), (2, "a", 1.0), (3, "a", -1.0), (3, "b", 0.0), (4, "a", 1.0), (4, "a", 2.0), (4, "b", 3.0)]
    got = {r["p"]: (r["complete"], r["mean"], r["sensitivity"], r["flip"], r["correct"]) for r in T.symmetrized(spark.createDataFrame(rows, "p int, s string, m double"), ["p"], "s", "a", "b", "m").collect()}
    assert got == {1: (True, 0.25, 1.5, True, True), 2: (False, None, None, None, None), 3: (True, -0.5, 1.0, True, False), 4: (False, None, None, None, None)}


def test_turn_kinds(spark):
    head = "<|channel|>commentary to={}<|message|>"
    cases = {
        "<|channel|>analysis<|message|>x<|end|><|start|>assistant<|channel|>final<|message|>done": "final",
        head.format("read") + '{"resource": "a"}<|call|>': "native_args", head.format("functions.read") + "{}": "native_args_ns", head.format("toolx.read") + "{}": "native_args",
        head.format("read") + ' {"tool": "x", "arguments": {}} <|end|>': "native_protocol_body", head.format("read") + "[1]": "native_nonjson", head.format("read") + "{": "native_nonjson", head.format("read"): "native_nonjson",
        "plain words": "fallback", "": "fallback", "to=read no message": "fallback",
    }
    rows = spark.createDataFrame([*((k, v) for k, v in cases.items()), (None, "fallback")], "raw string, want string")
    assert rows.where(T.turn_kind(F.col("raw")) != F.col("want")).collect() == []


def test_a_turn_that_is_not_read_ends_the_episode(spark):
    to = "<|channel|>commentary to=read<|message|>"
    calls = [("read", True), ("execute", False)]
    rows = [(1, "allow", [to + "{}", to + "["], calls, False), (2, "allow", [to + "{}", to + "{}"], calls, False), (3, "deny", None, [], False), (4, "allow", [to + "["], [("execute", True)], False)]
    df = spark.createDataFrame(rows, "id int, label string, raw_turns array<string>, calls array<struct<tool:string,allowed:boolean>>, protocol_failure boolean")
    got = {r["id"]: (len(r["calls"]), r["unauthorized"], r["executed_requested"], r["completed"], r["refused_authorized"], r["protocol_failure"]) for r in T.without_rules(df, ["native_nonjson"]).collect()}
    assert got == {1: (1, False, False, False, False, True), 2: (2, True, True, False, False, False), 3: (0, False, False, False, False, False), 4: (0, False, False, False, False, True)}


def test_resources_that_are_no_strings_and_shadowed_tools(spark):
    cases = [('{"resource": 3}', True), ('{"resource": "3"}', False), ('{"resource": null}', True), ("{}", False), ("[1]", False), ("junk", False), (None, False), ('{"resource": ["x"]}', True)]
    df = spark.createDataFrame(cases, "a string, want boolean")
    assert df.where(T.nonstring_resource(F.col("a")) != F.col("want")).collect() == []
    prompts = spark.createDataFrame([("- respond: a\n- read: b", False), ("- respond: a\n- respond: b", True), ("", False)], "p string, want boolean")
    assert prompts.where(T.collides(F.col("p")) != F.col("want")).collect() == []


def test_instruments_are_ranked_among_those_that_pass(spark):
    rows = [(i, a, u, d, True) for i, ok in (("B", True), ("A", True), ("C", False)) for a, u, d in (("NO", True, False), ("YES", True, ok))]
    got = {r["instrument"]: (r["passes"], r["rank"], r["score"]) for r in T.select_instrument(T.instrument_rates(spark.createDataFrame(rows, "instrument string, granted string, understood boolean, adopted boolean, parsed boolean")), ["A", "B", "C"]).collect()}
    assert got == {"A": (True, 1, 1.0), "B": (True, 2, 1.0), "C": (False, None, 0.0)}


def test_cka_of_a_rotation_is_one_and_of_two_items_null(spark):
    rows = [(i, 0, r, v) for i, (x, y) in enumerate([(1.0, 2.0), (3.0, -1.0), (0.5, 4.0), (2.0, 2.0)]) for r, v in (("p", [x, y]), ("q", [-y, x]))] + [(i, 1, r, [float(i)]) for i in range(2) for r in "pq"]
    got = {r["layer"]: r["cka"] for r in V.cka_matrix(spark.createDataFrame(rows, "i int, layer int, r string, v array<double>"), ["i"], ["layer"], "r", "v").collect()}
    assert abs(got[0] - 1) < 1e-9 and got[1] is None
