import random

import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import policy_text as T

NAMES = ["a", "x y", 'q"t', "is not", "n|b", "or", "é and ü", "a::b", "line\nbreak", "5", "true", "when.then", "1%2"]
FORMS = [(T.prose, T.read_prose), (T.table, T.read_table), (T.duties, T.read_duties), (T.as_json, T.read_json)]


def _policy(seed):
    r = random.Random(seed)
    name = lambda: r.choice(NAMES)
    scope = lambda: r.choice([S.any_scope(), S.eq_scope(name(), name()), S.is_scope(name()), S.in_scope(name(), name()), S.in_scope(name(), name(), name())])
    operand = lambda: r.choice([S.attr(r.choice(["principal", "resource", "context"]), name()), S.literal(name()), S.literal(r.randint(-5, 99)), S.literal(r.random() < 0.5), S.literal("")])
    conditions = lambda: [(operand(), r.choice(["==", "!=", "<", "<=", ">", ">="]), operand()) for _ in range(r.randint(0, 3))]
    return [S.rule(f"r{i} {name()}", r.choice(["permit", "forbid"]), scope(), sorted(r.sample(NAMES, r.randint(1, 3))), scope(), *conditions()) for i in range(r.randint(0, 5))]


@pytest.fixture(scope="module")
def policies(spark):
    return spark.createDataFrame([(i, _policy(i)) for i in range(80)], f"id int, rules array<{S.RULE}>").cache()


@pytest.mark.parametrize("write, read", FORMS, ids=lambda f: f.__name__)
def test_policies_read_back(policies, write, read):
    back = policies.withColumn("text", write(F.col("rules"))).withColumn("back", read(F.col("text")))
    for row in back.collect():
        want = sorted(row["rules"], key=lambda x: x["rule_id"])
        got = sorted(row["back"], key=lambda x: x["rule_id"])
        assert [{**r.asDict(True), "actions": sorted(r["actions"])} for r in got] == [{**r.asDict(True), "actions": sorted(r["actions"])} for r in want], row["text"]


@pytest.mark.parametrize("write, read", FORMS, ids=lambda f: f.__name__)
def test_spoilt_texts_are_not_read(policies, write, read):
    spoilt = policies.where("size(rules) > 1").select(F.explode(F.array(F.concat(write(F.col("rules")), F.lit("\nmore")), F.concat(F.lit("x"), write(F.col("rules"))))).alias("t"))
    if read is T.read_json:
        spoilt = spoilt.where("t like 'x%'")
    assert spoilt.where(read(F.col("t")).isNotNull()).collect() == []


def test_normal_form_forgets_ids_and_order_only(policies):
    own = policies.where("size(rules) > 0")
    moved = F.transform(F.reverse("rules"), lambda r: r.withField("rule_id", F.concat(F.lit("z"), r["rule_id"])).withField("conditions", F.reverse(r["conditions"])))
    flipped = F.transform("rules", lambda r: r.withField("effect", F.when(r["effect"] == "permit", "forbid").otherwise("permit")))
    assert own.where(T.normal_form(F.col("rules")) != T.normal_form(moved)).count() == 0
    assert own.where(T.normal_form(F.col("rules")) == T.normal_form(flipped)).where("size(rules) = 1").count() == 0
