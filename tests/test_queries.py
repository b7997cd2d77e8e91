"""Every query against the SQL that states its result, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", plans.queries())
def test_query(spark, sql, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([_plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    if name not in plans.oracle_sql():
        assert got
        return
    found = sql.execute(plans.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(([_plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=str)
