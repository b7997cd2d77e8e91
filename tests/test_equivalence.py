"""Rule sets read from answers, and their comparison over merged universes, against a plain evaluation of every request."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import readings as R
from tessera.operators import equivalence as E
from tessera.schemas import RULE, VALUE, any_scope, attr, eq_scope, in_scope, is_scope, literal, rule, value

GROUPS = {"user::ann": ["team::red", "team::all"], "user::bob": ["team::blue", "team::all"], "user::cat": [], "team::red": ["team::all"], "team::blue": ["team::all"], "team::all": [], "file::1": ["folder::a"], "file::2": [], "folder::a": []}
ATTRS = {"user::ann": {"level": 3, "name": "ann"}, "user::bob": {"level": 5, "name": "bob"}, "user::cat": {"level": 3, "name": "cat"}, "file::1": {"rank": 4}, "file::2": {"rank": 9}}
CONTEXT = {"hour": "int", "mfa": "bool", "zone": "str"}
ACTIONS = ["edit", "view"]


def _tables(spark):
    kind = lambda x: "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "str"
    entities = [("p", k, k.split("::")[0], [k, *g], {a: value(v) for a, v in ATTRS.get(k, {}).items()}) for k, g in GROUPS.items()]
    attrs = sorted({("p", k.split("::")[0], a, kind(v)) for k, vs in ATTRS.items() for a, v in vs.items()})
    return (
        spark.createDataFrame(entities, f"policy_id string, key string, type string, groups array<string>, attrs map<string,{VALUE}>"), spark.createDataFrame(attrs, "policy_id string, type string, attr string, kind string"),
        spark.createDataFrame([("p", a) for a in ACTIONS], "policy_id string, action string"), spark.createDataFrame([("p", *x) for x in CONTEXT.items()], "policy_id string, attr string, kind string"),
    )


def _options(rules):
    seen = {k: set() for k in CONTEXT}
    for r in rules:
        for left, _, right in r[5]:
            if left[0] == "context" and right[2] is not None:
                seen[left[1]].add(next(x for x in right[2][1:] if x is not None))
    out = {"mfa": [False, True], "zone": [*sorted(seen["zone"]), "__unseen__"]}
    return out | {"hour": sorted({v + d for v in seen["hour"] for d in (-1, 0, 1)} or {0})}


def _allows(rules, who, action, what, context):
    def within(s, k):
        target = s[1] and "::".join(s[1])
        member = k == target or target in GROUPS[k]
        return {"any": True, "eq": k == target, "is": k.split("::")[0] == s[2], "in": member, "is_in": member and k.split("::")[0] == s[2]}[s[0]]

    def get(o):
        return next(x for x in o[2][1:] if x is not None) if o[2] else {"principal": ATTRS.get(who, {}), "resource": ATTRS.get(what, {}), "context": context}[o[0]][o[1]]

    tests = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    hit = {r[1] for r in rules if within(r[2], who) and action in r[3] and within(r[4], what) and all(tests[op](get(a), get(b)) for a, op, b in r[5])}
    return hit == {"permit"}


def _compared(gold, given):
    options = _options(gold + given)
    users, files = sorted(k for k in GROUPS if k.startswith("user")), sorted(k for k in GROUPS if k.startswith("file"))
    n, over, under, first = 0, 0, 0, None
    for who, action, what, hour, mfa, zone in itertools.product(users, ACTIONS, files, options["hour"], options["mfa"], options["zone"]):
        context = {"hour": hour, "mfa": mfa, "zone": zone}
        a, b = _allows(gold, who, action, what, context), _allows(given, who, action, what, context)
        n, over, under = n + 1, over + (b and not a), under + (a and not b)
        if a != b and first is None:
            first = (who, action, what, f"hour={hour},mfa={str(mfa).lower()},zone={zone}")
    return n, over + under, over, under, *(first or (None,) * 4)


def _random_rules(r, n):
    who = [any_scope(), eq_scope("user", "ann"), is_scope("user"), in_scope("team", "red"), in_scope("team", "all", "user")]
    what = [any_scope(), eq_scope("file", "2"), is_scope("file"), in_scope("folder", "a")]
    tests = [(attr("context", "hour"), "<", literal(7)), (attr("context", "hour"), ">=", literal(3)), (attr("context", "mfa"), "==", literal(True)), (attr("context", "zone"), "!=", literal("eu")), (attr("context", "zone"), "==", literal("us"))]
    mixed = [(attr("context", "hour"), "<=", attr("principal", "level")), (attr("principal", "level"), "<", attr("resource", "rank")), (attr("principal", "name"), "==", literal("bob"))]
    out = []
    for i in range(n):
        # Only users have levels and only files have ranks.
        typed = r.random() < 0.5
        p, q = (r.choice([who[1], who[2], who[4]]), r.choice(what[1:3])) if typed else (r.choice(who), r.choice(what))
        out.append(rule(f"r{i}", r.choice(["permit", "permit", "forbid"]), p, r.sample(ACTIONS, r.randint(1, 2)), q, *r.sample(tests + (mixed if typed else []), r.randint(0, 2))))
    return out


def _scored(spark, gold, readings):
    g = spark.createDataFrame([("p", gold)], f"policy_id string, rules array<{RULE}>")
    given = spark.createDataFrame([("p", i, x) for i, x in enumerate(readings)], f"policy_id string, reading int, rules array<{RULE}>")
    return {r["reading"]: r for r in E.score_readings(g, given, *_tables(spark), ["user"], ["file"]).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_against_every_request(spark, seed):
    r = random.Random(seed)
    gold = _random_rules(r, 4)
    # Over 64 rules, so that masks have more than one word a side.
    readings = [_random_rules(r, r.randint(1, 5)) for _ in range(10)] + [gold[::-1], [], [("x" + g[0], *g[1:]) for g in gold], _random_rules(r, 70)]
    got = _scored(spark, gold, readings)
    assert len(got) == len(readings)
    for i, given in enumerate(readings):
        x = got[i]
        assert x["valid"] and x["problem"] is None
        assert tuple(x[c] for c in ("requests", "differ", "over", "under", "principal", "action", "resource", "context")) == _compared(gold, given), i
        assert x["equivalent"] == (x["differ"] == 0)
    assert got[10]["exact"] and got[12]["exact"] and not got[11]["exact"]


def test_exact_equivalent_and_valid_are_told_apart(spark):
    gold = [rule("a", "permit", in_scope("team", "red"), ["view"], is_scope("file"), (attr("context", "hour"), "<", literal(7)))]
    change = lambda op, x: [rule("b", "permit", in_scope("team", "red"), ["view"], is_scope("file"), (attr("context", "hour"), op, literal(x)))]
    wrong = {
        "unknown entity": rule("w", "permit", eq_scope("user", "zoe"), ["view"], any_scope()), "unknown type": rule("w", "permit", is_scope("robot"), ["view"], any_scope()), "unknown action": rule("w", "permit", any_scope(), ["burn"], any_scope()),
        "unknown attribute": rule("w", "permit", any_scope(), ["view"], any_scope(), (attr("principal", "level"), "==", literal(3))), "mismatched types": rule("w", "permit", any_scope(), ["view"], any_scope(), (attr("context", "hour"), "==", literal("7"))),
        "ordered without integers": rule("w", "permit", any_scope(), ["view"], any_scope(), (attr("context", "zone"), "<", literal("eu"))),
    }
    readings = [change("<", 7), change("<=", 6), change("<=", 7), None, *([*change("<", 7), w] for w in wrong.values())]
    got = _scored(spark, gold, readings)
    assert [(got[i]["valid"], got[i]["exact"], got[i]["equivalent"]) for i in range(4)] == [(True, True, True), (True, False, True), (True, False, False), (False, False, False)]
    assert (got[2]["differ"], got[2]["principal"], got[2]["context"]) == (1 * 2 * 2, "user::ann", "hour=7,mfa=false,zone=__unseen__")
    assert [got[4 + i]["problem"] for i in range(len(wrong))] == list(wrong) and not any(got[4 + i]["valid"] or got[4 + i]["exact"] for i in range(len(wrong)))


def test_equal_readings_are_scored_once(spark):
    gold = _random_rules(random.Random(9), 3)
    g = spark.createDataFrame([("p", gold)], f"policy_id string, rules array<{RULE}>")
    many = spark.range(500).select(F.lit("p").alias("policy_id"), F.col("id").alias("reading")).join(g, "policy_id")
    named, pairs = E.classes(g, many)
    assert pairs.count() == 1 and named.count() == 500


def test_readings_are_read_strictly(spark):
    rules = [rule("r2", "permit", in_scope("team", "red", "user"), ["edit", "view"], is_scope("file"), (attr("context", "hour"), "<", literal(-3)), (attr("principal", "a.b"), "!=", attr("resource", "k"))), rule('r"1', "forbid", any_scope(), ["é"], eq_scope("t", "i"), (attr("context", "mfa"), "==", literal(True)), (attr("context", "zone"), "==", literal("3")))]
    df = spark.createDataFrame([("p", rules)], f"policy_id string, rules array<{RULE}>").select("rules", R.as_reading(F.col("rules")).alias("t"))
    text = df.first()["t"]
    plain = json.loads(text)
    assert [set(x) for x in plain["rules"]] == [set(R.FIELDS)] * 2 and plain["rules"][0]["id"] == 'r"1'
    cases = {"rules": [text, f"```json\n{text}\n```", f"<think>x</think> {text}", '{"rules": []}'], "parse_failure": [text[:-1], "", None, '{"rules": {}}', "[]"], "refusal": ["I cannot say."], "abstain": ["It is unclear."]}

    def spoilt(change):
        own = json.loads(text)
        change(own, own["rules"][1])
        return json.dumps(own)

    changes = [
        lambda o, r: o.update(more=1), lambda o, r: r.pop("id"), lambda o, r: r.update(note=1), lambda o, r: r.update(id=""), lambda o, r: r.update(id=3), lambda o, r: r.update(effect="permit"), lambda o, r: r.update(actions=[]),
        lambda o, r: r.update(actions=["a", 1]), lambda o, r: r.update(actions="a"), lambda o, r: r.update(conditions_mode="any"), lambda o, r: r["principal"].update(match="some"), lambda o, r: r["principal"].update(match="any"),
        lambda o, r: r["resource"].update(entity={"type": "a", "id": "b"}), lambda o, r: r["principal"]["entity"].update(id=""), lambda o, r: r["conditions"][0].update(op="="), lambda o, r: r["conditions"][0].update(left=3),
        lambda o, r: r["conditions"][0].update(right=1.5), lambda o, r: r["conditions"][0].update(right=None), lambda o, r: r["conditions"][0]["left"].update(attr="world.x"), lambda o, r: r["conditions"][0]["left"].update(attr="context."), lambda o, r: r.update(conditions={}),
    ]
    cases["parse_failure"] += [spoilt(c) for c in changes]
    rows = [(k, t) for k, ts in cases.items() for t in ts]
    got = spark.createDataFrame(rows, "want string, t string").select("want", "t", R.read_reading(F.col("t")).alias("x")).collect()
    assert [(r["want"], r["t"]) for r in got if r["want"] != r["x"]["category"]] == []
    assert all((r["x"]["rules"] is not None) == (r["want"] == "rules") for r in got)
    back = df.select(R.read_reading(F.col("t"))["rules"].alias("back"), "rules").first()
    assert sorted(back["back"]) == sorted(back["rules"])


def test_members_that_compare_alike_are_one_cell(spark):
    # 4,000 levels against 300 files of three ranks, and hours of the request: cells of single members would be over a million pairs.
    value_of = lambda kind: F.struct(F.lit("int").alias("t"), F.lit(None).cast("string").alias("s"), F.col("id").alias("i"), F.lit(None).cast("boolean").alias("b")) if kind == "int" else None
    entity = lambda n, kind, attr_, v: spark.range(n).select(F.lit("p").alias("policy_id"), F.format_string(f"{kind}::%05d", "id").alias("key"), F.lit(kind).alias("type"), F.array(F.format_string(f"{kind}::%05d", "id")).alias("groups"), F.create_map(F.lit(attr_), v).alias("attrs"))
    users, files = entity(4000, "user", "level", value_of("int")), entity(300, "file", "rank", value_of("int").withField("i", F.col("id") % 3 * 1000 + 500))
    make = lambda op: [rule("a", "permit", is_scope("user"), ["view"], is_scope("file"), (attr("principal", "level"), op, attr("resource", "rank"))), rule("b", "permit", is_scope("user"), ["edit"], is_scope("file"), (attr("context", "hour"), "<=", attr("principal", "level")), (attr("context", "hour"), ">=", literal(7)))]
    pairs = spark.createDataFrame([("x", "p", make("<"), make("<="), False)], f"pair string, policy_id string, gold array<{RULE}>, given array<{RULE}>, exact boolean")
    actions, context = spark.createDataFrame([("p", a) for a in ACTIONS], "policy_id string, action string"), spark.createDataFrame([("p", "hour", "int")], "policy_id string, attr string, kind string")
    got = E.disagreements(pairs, users, actions, files, context).first()
    # The levels 500, 1500 and 2500 each meet 100 files of the same rank at three hours, of two actions.
    assert tuple(got)[1:] == (4000 * 2 * 300 * 3, 900, 900, 0, "user::00500", "view", "file::00000", "hour=6")

    crossings = spark.createDataFrame([("p", "principal", "level", "resource.rank"), ("p", "resource", "rank", "principal.level")], "policy_id string, subject string, attr string, other string")
    axis = lambda df: (df.select("policy_id", F.col("key").alias("n"), F.col("attrs").alias("values")), ["policy_id", "n"])
    coded = E._with_codes({"principal": axis(users), "resource": axis(files)}, crossings)
    assert [coded[a].select("codes").distinct().count() for a in ("principal", "resource")] == [7, 3]


def test_values_of_one_code_compare_alike(spark):
    r = random.Random(5)
    pool = [None, ("int", None, None, None), ("str", None, None, None), *(value(x) for x in (True, False, "a", "b", "c", "d", "", -3, 0, 1, 2, 3, 5, 8, 13))]
    for _ in range(2):
        mine, theirs = ([(i, r.choice(pool)) for i in range(n)] for n in (60, 5))
        make = lambda rows: (spark.createDataFrame([("p", i, {"k": v} if v else {}) for i, v in rows], f"policy_id string, n int, values map<string,{VALUE}>"), ["policy_id", "n"])
        crossings = spark.createDataFrame([("p", "principal", "k", "resource.k"), ("p", "resource", "k", "principal.k")], "policy_id string, subject string, attr string, other string")
        coded = E._with_codes({"principal": make(mine), "resource": make(theirs)}, crossings)["principal"]
        ops = F.array(*(F.coalesce(E.compare(F.col("x"), F.lit(op), F.col("y")), F.lit(False)) for op in ("==", "!=", "<", "<=", ">", ">=")))
        others = spark.createDataFrame(theirs, f"o int, y {VALUE}")
        told = coded.select("n", F.to_json("codes").alias("code"), F.element_at("values", F.lit("k")).alias("x")).crossJoin(others).select("code", "o", ops.alias("told")).distinct()
        assert told.groupBy("code", "o").count().where("count > 1").count() == 0
