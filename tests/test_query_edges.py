"""Queries on small tables unlike the given ones, against what their SQL says of them."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.plans import answers


def _both(spark, query, sql, folder, **tables):
    """Rows of a query and of its SQL over the given tables, in order; NaN and null told apart."""
    con = duckdb.connect()
    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    df = query(spark, str(folder))
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    plain = lambda rows: sorted(([repr(round(v, 9)) if isinstance(v, float) else v for v in r] for r in rows), key=str)
    return plain(df.select(*names).collect()), plain(found.fetchall())


def _documents(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": [r[1] for r in rows], "n_chars": pa.array([r[2] for r in rows], pa.int64())})


def _spearman(spark, folder, rows):
    got, want = _both(spark, answers.spearman_avg_rank, answers.SQL["spearman_avg_rank"], folder, documents=_documents(rows))
    assert got == want
    return got


def test_rank_correlation_of_a_constant_side_is_nan_with_p_1(spark, tmp_path):
    # Worlds of the same documents have one accuracy; their lengths differ by whole periods of the hash of an answer.
    rows = [(100003 * w + i, f"s{w}", 100 + 2000 * w) for w in range(4) for i in range(5)]
    assert {(r[1], r[2], r[3]) for r in _spearman(spark, tmp_path, rows)} == {(4, repr(math.nan), repr(1.0))}


def test_rank_correlation_of_two_worlds_and_of_unknown_lengths(spark, tmp_path):
    two = [(7 * i + w, f"s{w}", 120 + 310 * w + i) for w in range(2) for i in range(9)]
    assert {r[1] for r in _spearman(spark, tmp_path, two)} == {2}
    unknown = two + [(1000 + i, f"t{w}", None if w == 1 else 900 + w) for w in range(4) for i in range(6)]
    assert {r[1] for r in _spearman(spark, tmp_path, unknown)} == {6}
