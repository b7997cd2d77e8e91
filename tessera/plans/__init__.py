"""Registered queries over the given tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, audits, calls, designs, policies, readings, runs, series, studies, texts, trials

_MODULES = (policies, answers, texts, calls, series, studies, audits, trials, runs, readings, designs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
