"""Random policies against a small evaluator written straight from the semantics."""

import random

from tessera import schemas as S
from tessera.operators import policy as P

_SUBJECT = f"struct<key:string,type:string,groups:array<string>,attrs:map<string,{S.VALUE}>>"
_REQUESTS = f"n int, policy_id string, action string, principal {_SUBJECT}, resource {_SUBJECT}, context map<string,{S.VALUE}>"


def _scope(r, kind, groups):
    return r.choice([S.any_scope(), S.is_scope(kind), S.is_scope("other"), S.eq_scope(kind, str(r.randrange(4))), S.in_scope("group", r.choice(groups)), S.in_scope("group", r.choice(groups), kind)])


def _in(scope, key, kind, groups):
    name, entity, typed = scope
    target = entity and "::".join(entity)
    return {"any": True, "eq": key == target, "is": kind == typed, "in": target in groups, "is_in": kind == typed and target in groups}[name]


def _test(op, a, b):
    if op in ("==", "!="):
        return (type(a) is type(b) and a == b) == (op == "==")
    return type(a) is int and type(b) is int and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def test_random_policies(spark):
    r = random.Random(11)
    rules, plain, requests = [], {}, []
    for p in range(25):
        own = []
        for k in range(r.randint(1, 5)):
            conditions = [(S.attr(*r.choice([("context", "hour"), ("principal", "level"), ("resource", "public")])), r.choice(P.OPERATORS), r.choice([S.literal(r.randrange(5)), S.literal(True), S.literal("x"), S.attr("principal", "level")])) for _ in range(r.randint(0, 2))]
            own.append(S.rule(f"r{k}", r.choice(["permit", "permit", "forbid"]), _scope(r, "user", "gh"), r.sample(["a", "b"], r.randint(1, 2)), _scope(r, "repo", "gh"), *conditions))
        plain[f"p{p}"] = own
        rules += [(f"p{p}", x) for x in own]
        for _ in range(30):
            subject = lambda kind, attrs: (k := f"{kind}::{r.randrange(4)}", kind, sorted({k, *(f"group::{g}" for g in "gh" if r.random() < 0.4)}), {n: S.value(v) for n, v in attrs.items()})
            requests.append((len(requests), f"p{p}", r.choice("ab"), subject("user", {"level": r.randrange(5)}), subject("repo", {"public": r.random() < 0.5}), {"hour": S.value(r.randrange(5))}))

    def decide(request, own):
        _, _, action, principal, resource, context = request
        found = {"principal": principal[3], "resource": resource[3], "context": context}
        unpack = lambda v: next(x for x in v[1:] if x is not None)
        get = lambda o: unpack(o[2]) if o[2] else unpack(found[o[0]][o[1]])
        hit = [x for x in own if action in x[3] and _in(x[2], *principal[:3]) and _in(x[4], *resource[:3]) and all(_test(op, get(a), get(b)) for a, op, b in x[5])]
        permits, forbids = ([x[0] for x in hit if x[1] == e] for e in ("permit", "forbid"))
        return ("allow" if permits and not forbids else "deny"), permits, forbids

    got = P.evaluate(spark.createDataFrame(requests, _REQUESTS), spark.createDataFrame(rules, S.RULES)).cache()
    for row in got.collect():
        assert (row["decision"], row["permits"], row["forbids"]) == decide(requests[row["n"]], plain[row["policy_id"]])
    flips = {}
    for q in requests:
        for x in plain[q[1]]:
            if decide(q, plain[q[1]])[0] != decide(q, [y for y in plain[q[1]] if y is not x])[0]:
                flips[q[1], x[0]] = flips.get((q[1], x[0]), 0) + 1
    assert {(x["policy_id"], x["rule_id"]): x["n"] for x in P.decisive_rules(got).collect()} == flips
