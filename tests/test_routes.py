"""Route counts against every route spelled out, and the problems of graphs with one fault each."""

import collections
import random

from tessera.operators import routes as R


def _routes(edges):
    """Every route of each graph that has no cycle, by walking; graphs with a cycle."""
    out, cyclic = collections.defaultdict(list), set()
    for g in {e[0] for e in edges}:
        after = collections.defaultdict(list)
        for x, a, b in edges:
            if x == g:
                after[a].append(b)
        found = []
        stack = [(a, [a]) for a in list(after)]
        while stack and g not in cyclic:
            start, path = stack.pop()
            for b in after.get(path[-1], ()):
                if b in path:
                    cyclic.add(g)
                else:
                    found.append((start, b, len(path)))
                    stack.append((start, [*path, b]))
        if g not in cyclic:
            for a, b, n in found:
                out[g, a, b].append(n)
    return {k: (len(v), min(v)) for k, v in out.items()}, cyclic


def test_counts_against_every_route(spark):
    r = random.Random(2)
    edges = []
    for g in range(14):
        n = r.randint(2, 8)
        for _ in range(r.randint(1, 14)):
            a, b = r.randrange(n), r.randrange(n)
            # Half the graphs run one way only.
            edges.append((g, f"n{min(a, b)}", f"n{max(a, b)}") if g % 2 and a != b else (g, f"n{a}", f"n{b}"))
    edges += [(90, f"k{i:02}", f"k{i + 1:02}") for i in range(40)] + [(91, f"k{i:02}", f"k{i + 1:02}") for i in range(40)] * 2 + [(92, "a", "a"), (93, None, "b")]
    df = spark.createDataFrame(edges, "graph int, source string, target string")
    want, cyclic = _routes([e for e in edges if None not in e and e[0] != 91])
    got = {(r["graph"], r["source"], r["target"]): (int(r["routes"]), r["depth"]) for r in R.route_counts(df).collect()}
    assert {k: v for k, v in got.items() if k[0] != 91} == want
    # Two edges a step: 2^40 routes that nobody spells out.
    assert got[91, "k00", "k40"] == (2**40, 40) and got[91, "k10", "k12"] == (4, 2)
    assert {r["graph"] for r in R.cyclic_graphs(df.where("graph != 93")).collect()} == cyclic and 92 in cyclic


def test_counts_of_nothing(spark):
    assert R.route_counts(spark.createDataFrame([], "graph int, source string, target string")).collect() == []


def test_problems(spark):
    def graph(g, chain, others, **change):
        rows = [(a, b, True) for a, b in zip(chain, chain[1:])] + [(*o, False) for o in others]
        return [(g, i, a, b, rel) for i, (a, b, rel) in enumerate(rows)], (g, change.get("start", "s"), change.get("end", chain[-1]), change.get("depth", len(chain) - 1), change.get("total", len(rows)))

    cases = {
        "fine": graph("fine", "sabt", [("x", "y"), ("z", "w")]), "cycle": graph("cycle", "sat", [("x", "y"), ("y", "x")]), "loop": graph("loop", "sat", [("x", "x")]), "two": graph("two", "sat", [("s", "t")]),
        "end": graph("end", "sat", [("x", "y")], end="u"), "deep": graph("deep", "sat", [("x", "y")], depth=3), "few": graph("few", "sat", [("x", "y")], total=4), "lost": graph("lost", "sat", [("x", "y")], start="q"),
    }
    edges = spark.createDataFrame([e for es, _ in cases.values() for e in es], "graph string, place int, source string, target string, relevant boolean")
    asked = spark.createDataFrame([a for _, a in cases.values()], "graph string, start string, end string, depth int, total int")
    got = collections.defaultdict(set)
    for r in R.route_problems(edges, asked).collect():
        got[r["graph"]].add((r["problem"], r["item"]))
    assert got == {
        "cycle": {("cycle", None)}, "loop": {("cycle", None), ("loop", "2")}, "two": {("several routes", "2"), ("touches the route", "2")}, "end": {("another end", "t")},
        "deep": {("another depth", "2"), ("number of relevant edges", "2")}, "few": {("number of edges", "3")}, "lost": {("no route", "q")},
    }
    place = {r["graph"]: (r["edges"], r["depth"], r["first"], r["span"]) for r in R.positions(edges).collect()}
    assert place["fine"] == (5, 3, 0, 3)
