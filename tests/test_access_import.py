"""Access documents as policies: worlds, witnesses, exclusions, and every request decided as the document decides it, against a plain evaluation."""

import fnmatch
import itertools
import json
import random
import re

from pyspark.sql import functions as F

from tessera.operators import access_import as A
from tessera.operators import iam as I
from tessera.operators import policy as P

TOKENS = A.WITNESS_TOKENS


def _list(x):
    return x if isinstance(x, list) else [x]


def _fits(glob, value, fold):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), value, re.S | (re.I if fold else 0)) is not None


def _members(statements, names, probe, axis):
    fold = axis == "action"
    values = [v for s in statements for n in names for v in _list(s.get(n, []))]
    concrete = sorted({v for v in values if not set("*?") & set(v)})
    patterns = {}
    for v in values:
        if set("*?") & set(v):
            patterns.setdefault(v.lower() if fold else v, v)
    taken, found = {(m.lower() if fold else m) for m in [*concrete, probe]}, []
    for p in sorted(patterns.values()):
        best = None
        for t in TOKENS[axis]:
            w = p.replace("*", t).replace("?", t[0].lower())
            if (w.lower() if fold else w) in taken:
                continue
            also = [o for o in patterns.values() if o != p and _fits(o, w, fold)]
            if best is None or len(also) < best[0]:
                best = (len(also), w)
        found.append(best[1])
        taken.add(best[1].lower() if fold else best[1])
    return [*concrete, *sorted(found), probe]


def _plain(doc):
    """(requests, allowed) over the document's world, by the document itself."""
    ss = _list(doc["Statement"])
    actions, resources = _members(ss, ("Action", "NotAction"), A.PROBES["action"], "action"), _members(ss, ("Resource", "NotResource"), A.PROBES["resource"], "resource")
    named = any("Principal" in s or "NotPrincipal" in s for s in ss)
    people, star = set(), False
    for s in ss:
        p = s.get("Principal", s.get("NotPrincipal"))
        star |= p == "*"
        if isinstance(p, dict):
            people |= {(t, v) for t, vs in p.items() for v in _list(vs)}
    who = [*sorted(people), *([A.ANYONE] if star else []), A.STRANGER] if named else [A.CALLER]
    def met(s, a, r, p):
        act = any(_fits(g, a, True) for g in _list(s.get("Action", s.get("NotAction")))) == ("Action" in s)
        res = any(_fits(g, r, False) for g in _list(s.get("Resource", s.get("NotResource")))) == ("Resource" in s)
        spec = s.get("Principal", s.get("NotPrincipal"))
        own = spec is None or spec == "*" or ((p in {(t, v) for t, vs in spec.items() for v in _list(vs)}) == ("Principal" in s))
        return act and res and own

    literals = {}
    for s in ss:
        # A statement that covers nothing of the world leaves no rule, so no literals.
        covers = any(met(s, a, r, p) for a, r, p in itertools.product(actions, resources, who))
        for op, block in s.get("Condition", {}).items():
            for k, vs in block.items():
                literals.setdefault(k, (I.OPERATORS[op], set()))[1].update(_list(vs) if covers else ())
    options = {}
    for k, (kind, vs) in literals.items():
        options[k] = [False, True] if kind == "bool" else sorted({int(v) + d for v in vs for d in (-1, 0, 1)} or {0}) if kind == "int" else [*vs, "__unseen__"]

    def holds(s, c):
        for op, block in s.get("Condition", {}).items():
            for k, vs in block.items():
                kind = I.OPERATORS[op]
                vs = [(str(v).lower() == "true") if kind == "bool" else int(v) if kind == "int" else v for v in _list(vs)]
                test = {"NumericLessThan": lambda v: c[k] < v, "NumericGreaterThanEquals": lambda v: c[k] >= v}.get(op, lambda v: c[k] == v)  # noqa: B023
                if any(map(test, vs)) == (op in I.NEGATED):
                    return False
        return True

    n = allowed = 0
    for a, r, p in itertools.product(actions, resources, who):
        for combo in itertools.product(*options.values()):
            c = dict(zip(options, combo))
            effects = {s["Effect"] for s in ss if met(s, a, r, p) and holds(s, c)}
            n, allowed = n + 1, allowed + (effects == {"Allow"})
    return n, allowed


def _random(r, people):
    def statement():
        s = {"Effect": r.choice(["Allow", "Allow", "Deny"]), r.choice(["Action", "Action", "NotAction"]): r.choice(["s3:Get*", ["s3:GetObject", "s3:Put*"], "*", ["s3:?et*", "s3:Put?bject"], "S3:PUT*"])}
        s[r.choice(["Resource", "Resource", "NotResource"])] = r.choice(["*", "arn:b/*", ["arn:b/one", "arn:b/?"], "arn:b/one"])
        if people:
            s[r.choice(["Principal"] * 4 + ["NotPrincipal"])] = r.choice([{"Service": ["ec2", "sqs"]}, {"Service": "sqs"}])
            if "Principal" in s and r.random() < 0.4:
                s["Principal"] = r.choice(["*", {"AWS": "u1", "Service": "ec2"}])
        if r.random() < 0.6:
            s["Condition"] = r.choice([{"StringEquals": {"z:a": ["x", "y:1"]}}, {"NumericLessThan": {"n": 5}, "Bool": {"mfa": "true"}}, {"StringNotEquals": {"z:a": ["x", "q"]}, "NumericGreaterThanEquals": {"n": ["3"]}}, {"NumericNotEquals": {"n": [4, 9]}}])
        return s

    return {"Version": "1", "Statement": [statement() for _ in range(r.randint(1, 3))]}


def _converted(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return A.convert(I.statements(spark.createDataFrame(rows, "key int, doc string").repartition(2), "key", "doc"))


def test_every_request_is_decided_as_the_document_does(spark):
    r = random.Random(11)
    docs = [_random(r, i % 2 == 0) for i in range(24)]
    converted = _converted(spark, docs)
    got = {x["key"]: x for x in A.faithfulness(converted).collect()}
    excluded = {x["key"]: x["excluded"] for x in converted.where("excluded is not null").collect()}
    assert len(got) > 15 and len(got) + len(excluded) == len(docs) and set(excluded.values()) <= {"no statement matches", "too many rules"}
    for k, x in got.items():
        assert (x["mismatches"], x["refusals"]) == (0, 0) and (x["requests"], x["allowed"]) == _plain(docs[k]), docs[k]


def test_witnesses(spark):
    one = spark.createDataFrame([(["s3:Get*", "s3:*Object", "s3:G?tX", "*"], ["s3:GetZzWitness"])], "p array<string>, t array<string>")
    got = [tuple(x) for x in one.select(A.witnesses(F.col("p"), F.col("t"), "action").alias("w")).first()["w"]]
    # The first token of s3:Get* is a member already, so the next is taken.
    assert got == [("*", "ZzWitness", []), ("s3:*Object", "s3:ZzWitnessObject", ["*"]), ("s3:G?tX", "s3:GztX", ["*"]), ("s3:Get*", "s3:GetQqWitness", ["*"])]
    full = spark.createDataFrame([(["a/*"], [f"a/{t}" for t in TOKENS["resource"]])], "p array<string>, t array<string>")
    assert full.select(A.witnesses(F.col("p"), F.col("t"), "resource").alias("w")).first()["w"][0]["witness"] is None
    assert fnmatch.fnmatchcase("s3:GetQqWitness", "s3:Get*")


def test_exclusions(spark):
    s = lambda **k: {"Statement": [{"Effect": "Allow", "Action": "a", "Resource": "b"} | k]}
    cases = [
        ("action case variant", s(Action=["s3:Get", "S3:GET"])), ("identifier collision", s(Resource=["b:1", "b.1"])), ("identifier collision", s(Condition={"StringEquals": {"k": ["x:", "x."]}})), ("identifier collision", s(Condition={"Bool": {"k:a": True, "k.a": True}})),
        ("condition key of two types", s(Condition={"StringEquals": {"k": "1"}, "NumericEquals": {"k": 1}})), ("too many rules", s(Resource=[f"r{i}" for i in range(65)])), ("too many rules", s(Condition={"NumericEquals": {f"k{i}": [1, 2] for i in range(7)}})),
        ("some statements name nobody", {"Statement": [{"Effect": "Allow", "Action": "a", "Resource": "b", "Principal": "*"}, {"Effect": "Deny", "Action": "a", "Resource": "b"}]}), ("no statement matches", {"Statement": {"Effect": "Allow", "NotAction": "*", "Resource": "b"}}),
        ("witness unavailable", s(Resource=["a/*", *(f"a/{t}" for t in TOKENS["resource"])])), ("effect", {"Statement": {"Effect": "Maybe", "Action": "a", "Resource": "b"}}), ("world too large", s(Resource="b", Condition={"NumericNotEquals": {f"k{i}": [1, 5, 9] for i in range(5)}})), ("json", "{"), ("no statement", {"Statement": []}), (None, s()),
    ]
    got = {x["key"]: x["excluded"] for x in _converted(spark, [d for _, d in cases]).collect()}
    assert [got[i] for i in range(len(cases))] == [want for want, _ in cases]


def test_conditions_are_judged_in_the_order_of_the_text(spark):
    first = '{"Statement": [{"Effect": "Deny", "Action": "*", "Resource": "*", "Condition": %s}, {"Effect": "Allow", "Action": "*", "Resource": "*"}]}'
    false, lacking = '"StringEquals": {"z": "no"}', '"Bool": {"lacking": "true"}'
    docs = [first % f"{{{false}, {lacking}}}", first % f"{{{lacking}, {false}}}", '{"Statement": {"Effect": "Deny", "Effect": "Allow", "Action": "x", "Action": "*", "Resource": "*", "Condition": {"StringEquals": {"z": "no", "z": "yes"}}}}', first % '{"NumericEquals": {"b": 1, "a": 2}}']
    parsed = I.statements(spark.createDataFrame(list(enumerate(docs)), "key int, doc string"), "key", "doc")
    from tessera.schemas import VALUE, value

    asked = spark.createDataFrame([(k, "a", "r", None, {"z": value("yes"), "b": value(2)}) for k in range(4)], f"key int, action string, resource string, principal struct<type:string,id:string>, context map<string,{VALUE}>")
    got = {r["key"]: (r["decision"], r["refused"]) for r in I.decide(asked, parsed).collect()}
    assert got == {0: ("allow", None), 1: ("deny", "context"), 2: ("allow", None), 3: ("allow", None)}


def test_documents_are_not_gathered_in_the_driver(spark, monkeypatch):
    # Files of documents that are much alike are small, however many the documents are; small files alone must not make Spark broadcast them.
    monkeypatch.setattr(P, "BROADCAST_RULES", 0)
    doc = '{"Statement": {"Effect": "Allow", "Action": "s3:Get*", "Resource": "*", "Condition": {"NumericLessThan": {"q": %d}}}}'
    docs = spark.createDataFrame([(i, doc % (i % 3)) for i in range(40)], "key long, doc string")
    converted = A.convert(I.statements(docs, "key", "doc"))
    found = A.faithfulness(converted)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (found, A.requests(converted)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert {(r["requests"], r["mismatches"], r["refusals"]) for r in found.collect()} == {(2 * 2 * 1 * 3, 0, 0)}
