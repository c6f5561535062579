"""Compare a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(d: str = DATA):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(d):
        t = name.split(".")[0]
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{name}'")
    return con


def same_rows(got, want) -> None:
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert len(got) == len(want)
    a = got[cols].sort_values(cols).reset_index(drop=True)
    b = want[cols].sort_values(cols).reset_index(drop=True)
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[~same].head(3), b[~same].head(3))
