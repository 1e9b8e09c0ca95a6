"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"


def rows(values):
    return sorted((tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in r) for r in values))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = rows(tuple(r[c] for c in cols) for r in df.collect())
    place = [want.columns.index(c) for c in cols]
    assert got == rows(tuple(r[i] for i in place) for r in want.fetchall())
