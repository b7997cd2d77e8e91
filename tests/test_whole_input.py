"""Queries do the whole job: each test would fail on a cut of the input, and states its result without the queries' SQL."""

import hashlib
import itertools
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import generate as G
from tessera.operators import policy as P
from tessera.operators import stats as S
from tessera.plans import answers, policies, series, studies

DATA = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def _rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("query", [series.episode_outcomes, series.episode_stream])
def test_the_fourth_step_of_an_episode_counts(spark, tmp_path, query):
    # Lengths give the tool (mod 4: 2 looks up, 0 responds) and whether it is allowed (not divisible by 3).
    logs = {1: [2, 2, 2, 6, 6], 2: [2, 2, 2, 4], 3: [2, 2, 2]}
    rows = [(c, t, "assistant", "x" * n) for c, log in logs.items() for t, n in enumerate(log)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows))))), tmp_path / "conversations.parquet")
    got = {r["episode"]: (r["status"], r["n_calls"], r["unauthorized"]) for r in query(spark, str(tmp_path)).collect()}
    assert got == {1: ("max_steps", 4, True), 2: ("responded", 3, False), 3: ("open", 3, False)}


@with_tables
def test_cka_reads_all_dimensions(spark):
    own = _rows("embeddings")
    for r in series.linear_cka(spark, DATA).collect():
        v = np.array([x["embedding"] for x in own if x["label"] == r["label"]], float)
        x, y = (h - h.mean(0) for h in (v[:, :32], v[:, 32:]))
        norm = lambda a, b: (np.square(a.T @ b)).sum()
        assert r["cka"] == pytest.approx(norm(x, y) / np.sqrt(norm(x, x) * norm(y, y)), abs=2e-6)


@with_tables
def test_drawn_policies_are_judged_on_all_sizes(spark):
    region = {r["r_regionkey"]: r["r_name"] for r in _rows("region")}
    nations = {r["n_nationkey"]: region[r["n_regionkey"]] for r in _rows("nation")}
    sizes, acts = sorted({r["p_size"] for r in _rows("part")}), ["audit", "return", "view"]
    ids = sorted({f"{r['c_mktsegment']}/{r['c_nationkey']}" for r in _rows("customer")})
    drawn = G.draw_rules(spark.createDataFrame([(i,) for i in ids], "policy_id string"), sorted(region.values()), acts, "nation", "part", "size", 50, seed=5)
    rules = {i: [] for i in ids}
    for r in drawn.collect():
        rules[r["policy_id"]].append(r["rule"])

    def matches(rule, nation, act, size):
        c = rule["conditions"][0] if rule["conditions"] else None
        bar = c and c["right"]["value"]["i"]
        within = rule["principal"]["kind"] == "is" or rule["principal"]["entity"]["id"] == nations[nation]
        return act in rule["actions"] and within and (c is None or (size < bar if c["op"] == "<" else size >= bar))

    def reason(own):
        allow, live = {}, set()
        for at in ((n, a, s) for n in nations for a in acts for s in sizes):
            hit = {e: [r["rule_id"] for r in own if r["effect"] == e and matches(r, *at)] for e in ("permit", "forbid")}
            allow[at] = bool(hit["permit"]) and not hit["forbid"]
            live |= set(hit["permit"] if allow[at] and len(hit["permit"]) == 1 else hit["forbid"] if hit["permit"] and len(hit["forbid"]) == 1 else [])
        seen = [{}, {}, {}]
        for at, v in allow.items():
            for k in range(3):
                seen[k].setdefault(at[:k] + at[k + 1 :], set()).add(v)
        edge = Counter(v for at, v in allow.items() if any(len(seen[k][at[:k] + at[k + 1 :]]) > 1 for k in range(3)))
        n = Counter(allow.values())
        if n[True] < 4 or n[False] < 4:
            return "too few allowed" if n[True] < 4 else "too few denied"
        return "too few on the boundary" if min(edge[True], edge[False]) < 2 else "dead rule" if len(own) > 1 and len(live) < len(own) else "ok"

    assert {r["reason"]: r["n"] for r in policies.drawn_policies(spark, DATA).collect()} == Counter(map(reason, rules.values()))


@with_tables
def test_intervals_and_tests_rest_on_the_published_replicates(spark):
    worlds = answers._worlds(spark, DATA).select("rendering", "world_id", "deny_to_allow").collect()
    units = sorted({r["world_id"] for r in worlds})
    draw = lambda k, i: int(hashlib.md5(f"{answers.SEED}|{k}|{i}".encode()).hexdigest()[:12], 16) % len(units)
    drawn = [Counter(units[draw(k, i)] for i in range(len(units))) for k in range(4000)]
    for r in answers.boot_ci_rates(spark, DATA).collect():
        own = {w["world_id"]: w["deny_to_allow"] for w in worlds if w["rendering"] == r["rendering"] and w["deny_to_allow"] is not None}
        means = [sum(own[u] * n for u, n in d.items() if u in own) / sum(n for u, n in d.items() if u in own) for d in drawn if any(u in own for u in d)]
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=2e-6)
    steps = [r["p"] * 10_001 for r in answers.sign_permutation(spark, DATA).collect()]
    assert all(abs(x - round(x)) < 0.01 for x in steps) and studies.REPLICATES == 4000


def test_rank_permutation_nears_all_orders(spark):
    x, y = [1, 2, 2, 4, 5, 6, 7], [2, 1, 3, 3, 7, 4, 6]
    rows = [("a", f"w{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("flat", f"w{i}", 1.0, float(i)) for i in range(5)] + [("few", f"w{i}", float(i), float(i)) for i in range(2)]
    got = S.rank_permutation(spark.createDataFrame(rows, "g string, world_id string, x double, y double"), "x", "y", ["g"], "world_id", 4000, 1).collect()
    rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
    rx, ry = rank(x), rank(y)
    rho = np.corrcoef(rx, ry)[0, 1]
    exact = np.mean([abs(np.corrcoef(p, ry)[0, 1]) >= abs(rho) - 1e-12 for p in itertools.permutations(rx)])
    assert [r["g"] for r in got] == ["a"] and abs(got[0]["p"] - exact) < 0.015


def test_closure_has_no_depth_limit(spark):
    n = 68
    chain = [("p", f"k{i}", f"k{i + 1}") for i in range(n)] + [("q", f"c{i}", f"c{(i + 1) % n}") for i in range(n)]
    got = P.closure(spark.createDataFrame(chain, "policy_id string, key string, parent string").coalesce(1))
    pairs = [tuple(r) for r in got.collect()]
    want = {("p", f"k{i}", f"k{j}") for i in range(n) for j in range(i + 1, n + 1)} | {("q", f"c{i}", f"c{j}") for i in range(n) for j in range(n)}
    assert len(pairs) == len(want) and set(pairs) == want
