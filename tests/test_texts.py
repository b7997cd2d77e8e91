import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import iam as I

_SHORT = [
    ("lynx", "correct", "lynx"), (' "lynx". ', "correct", "lynx"), ("**otter**", "incorrect", "otter"), ("<think>hm</think>\nlynx", "correct", "lynx"), ("“lynx”", "correct", "lynx"),
    ("I can’t say", "refusal", None), ("It is unclear", "abstain", None), ("lynx or otter", "parse_failure", None), ("lynx..", "parse_failure", None), ("", "parse_failure", None), ("Lynx", "parse_failure", None),
]


def test_short_answers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(_SHORT)], "i int, t string")
    got = df.select("i", X.short_answer(F.col("t"), F.array(F.lit("lynx"), F.lit("otter")), F.lit("lynx")).alias("r")).orderBy("i").collect()
    assert [(r["r"]["category"], r["r"]["selected"]) for r in got] == [(c, s) for _, c, s in _SHORT]
    old = df.select("i", X.short_answer(F.col("t"), F.array(F.lit("lynx"), F.lit("otter")), F.lit("lynx"), 1).alias("r")).orderBy("i").collect()
    assert old[4]["r"]["category"] == "parse_failure" and old[4]["r"]["lenient"] == "lynx" and old[5]["r"]["category"] == "parse_failure"


def _read(spark, reader, rows):
    """(category, value) of each (text, task, expected)."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, task string, expected string")
    return [tuple(r["r"]) for r in df.withColumn("r", reader(F.col("text"), F.col("task"), F.col("expected"))).orderBy("i").collect()]


def test_structured_answers(spark):
    cases = [
        ('{"decision": "allow"}', "correct"), ('```json\n{"decision": "allow"}\n```', "correct"), ('{"decision": "allow"}.', "correct"), ('{"decision": "deny", "decision": "allow"}', "correct"),
        ('{"decision": "deny"}', "incorrect"), ("{'decision': 'allow'}", "parse_failure"), ('{"decision": "allow"} yes', "parse_failure"), ('{"decision": "allow", "x": 1}', "parse_failure"),
        ('so</think>{"decision": "allow"}', "correct"), ("<think>a</think> ```\n {\"decision\": \"allow\"} \n```", "correct"), ("I won't", "refusal"), ("unknown", "abstain"), ('{"x": "unknown"}', "parse_failure"), ("[1]", "parse_failure"), (None, "parse_failure"),
    ]
    assert [c for c, _ in _read(spark, X.structured_answer, [(t, "application", "allow") for t, _ in cases])] == [c for _, c in cases]


def test_the_last_valid_object_counts(spark):
    texts = ['{"decision": "deny"} no, {"decision": "allow"} {"x": {"decision": "deny"}}', "well\nit is unclear", "it is unclear\nwell", "I will not. " + "x" * 401]
    assert _read(spark, X.final_answer, [(t, "application", "allow") for t in texts]) == [("correct", "allow"), ("abstain", None), ("parse_failure", None), ("parse_failure", None)]


def test_sets_of_ids_ignore_order_and_refuse_repeats(spark):
    want = json.dumps(["a", "b"])
    got = _read(spark, X.structured_answer, [('{"principals": ["b", "a"]}', "interpretation", want), ('{"principals": []}', "interpretation", "[]"), ('{"principals": ["a", "a"]}', "interpretation", want)])
    assert got == [("correct", want), ("correct", "[]"), ("parse_failure", None)]


def test_channels_and_renderings(spark):
    raw = spark.createDataFrame([("<|channel|>analysis<|message|> so <|end|><|start|>assistant<|channel|>final<|message|> yes <|return|>",), ("<|channel|>analysis<|message|>cut off",)], "t string")
    got = [tuple(r["c"]) for r in raw.select(X.channels(F.col("t")).alias("c")).collect()]
    assert got == [("yes", True, "so"), ("", False, "cut off")]
    rules = spark.createDataFrame([("forbid", "g", ["b", "a"], "doc")], "effect string, grp string, actions array<string>, kind string")
    parts = [F.col(c) for c in rules.columns]
    back = rules.select(X.sentence_rule(X.rule_sentence(*parts)).alias("s"), X.row_rule(X.rule_row(*parts)).alias("t"), X.sentence_rule(F.lit("Members of g may.")).alias("n")).first()
    assert tuple(back["s"]) == tuple(back["t"]) == ("forbid", "g", ["a", "b"], "doc") and back["n"] is None


def _access(spark, doc, *requests):
    from tessera import schemas as S

    rows = [(1, a, r, p, {k: S.value(v) for k, v in c.items()}) for a, r, p, c in requests]
    parsed = I.statements(spark.createDataFrame([(1, doc)], "key int, doc string"), "key", "doc")
    got = I.decide(spark.createDataFrame(rows, f"key int, action string, resource string, principal struct<type:string,id:string>, context map<string,{S.VALUE}>"), parsed)
    return [r["refused"] or r["decision"] for r in got.collect()]


def test_access_documents(spark):
    one = '{"Statement": {"Effect": "Allow", "Action": "s3:Get*", "Resource": "a/?"}}'
    assert _access(spark, one, ("S3:GETX", "a/b", None, {}), ("s3:Get", "a/bc", None, {}), ("s3:Get", "A/b", None, {})) == ["allow", "deny", "deny"]
    two = '{"Statement": [{"Effect": "Allow", "Action": "*", "Resource": "*"}, {"Effect": "Deny", "NotAction": ["s3:Get*"], "Resource": "*", "Condition": {"NumericLessThan": {"n": "3"}}}]}'
    assert _access(spark, two, ("s3:Put", "x", None, {"n": 2}), ("s3:Put", "x", None, {"n": 3}), ("s3:Put", "x", None, {}), ("s3:Put", "x", None, {"n": "2"}), ("s3:Get", "x", None, {})) == ["deny", "allow", "context", "context", "allow"]
    assert _access(spark, '{"Statement": [{"Effect": "Maybe", "Action": "*", "Resource": "*"}]}', ("a", "x", None, {})) == ["effect"]
    assert _access(spark, "no json", ("a", "x", None, {})) == ["json"]


def test_conditions_that_are_not_understood_deny(spark):
    doc = lambda c: f'{{"Statement": {{"Effect": "Allow", "Action": "*", "Resource": "*", "Condition": {c}}}}}'
    y = ("a", "x", None, {"k": "y", "b": True, "i": 4})
    for c, want in [('"junk"', "condition"), ('{"StringEquals": {"k": ["x", "y"]}}', "allow"), ('{"StringNotEquals": {"k": ["x", "y"]}}', "deny"), ('{"Bool": {"b": "TRUE"}}', "allow"), ('{"Bool": {"b": [false]}}', "deny"), ('{"NumericNotEquals": {"i": [1, "4"]}}', "deny"), ('{"NumericEquals": {"k": 1}}', "context"), ('{"StringEquals": {"z": "y"}}', "context"), ("null", "condition")]:
        assert _access(spark, doc(c), y) == [want], c


def test_principals(spark):
    doc = lambda p: f'{{"Statement": {{"Effect": "Allow", {p}, "Action": "*", "Resource": "*"}}}}'
    people = [("a", "x", p, {}) for p in (("AWS", "u"), ("Service", "u"), None)]
    assert _access(spark, doc('"Principal": {"AWS": ["t", "u"]}'), *people) == ["allow", "deny", "deny"]
    assert _access(spark, doc('"Principal": "*"'), *people) == _access(spark, doc('"Principal": {"AWS": "*"}'), *people) == ["allow"] * 3
    assert _access(spark, doc('"NotPrincipal": {"Service": "u"}'), *people) == ["allow", "deny", "allow"]
    assert _access(spark, doc('"Principal": {"AWS": "u*"}'), *people) == ["principal"] * 3


def test_globs_stop_at_lines_unless_case_is_folded(spark):
    doc = '{"Statement": {"Effect": "Allow", "Action": "a*", "Resource": ["p/*", "q?*r"]}}'
    assert _access(spark, doc, ("A\nb", "p/x", None, {}), ("a", "p/x\ny", None, {}), ("a", "qxyr", None, {}), ("a", "qr", None, {}), ("a", "P/", None, {})) == ["allow", "deny", "allow", "deny", "deny"]


def test_canonical_json(spark):
    got = [r[0] for r in spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",), (None,)], "t string").select(X.canonical_json(F.col("t"))).collect()]
    assert got == ['{"a":"\\u00e9","b":1}', None, None]
