"""What changed between two texts, line by line: a longest common subsequence by bit-parallel steps, and the edits that lead from one to the other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EDITS = "array<struct<op:string,at:int,line:string>>"


def edits_between(a: list[str], b: list[str]) -> list[tuple[str, int, str]]:
    """(-, place in a, line) and (+, place in b, line), in order, of a shortest way from a to b.

    Bit i of a row is 0 where the common subsequence of a[: i + 1] and b so far is longer than that of a[:i]. A row follows from the one before in a
    handful of operations on integers as wide as a; the rows, walked back from the end, tell which lines were kept. Where ways are equally short, removals come late.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    own, other = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[str, int] = {}
    for i, x in enumerate(own):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(own)) - 1
    rows = [row]
    for y in other:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
        rows.append(row)
    out, i, j = [], len(own), len(other)
    while i or j:
        if i and rows[j] >> i - 1 & 1:
            i -= 1
            out.append(("-", head + i, own[i]))
        elif j and (not i or not rows[j - 1] >> i - 1 & 1):
            j -= 1
            out.append(("+", head + j, other[j]))
        else:
            i, j = i - 1, j - 1
    return out[::-1]


def line_edits(a: Column, b: Column) -> Column:
    """Edits (op, at, line) from one array of lines to another; a null array has no lines."""

    @F.pandas_udf(EDITS)
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        lines = lambda x: [] if x is None else list(x)
        return pd.Series([[{"op": o, "at": i, "line": t} for o, i, t in edits_between(lines(x), lines(y))] for x, y in zip(before, after)], dtype=object)

    return run(a, b)
