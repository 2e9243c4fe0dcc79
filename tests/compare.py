"""Holds a query's rows against those of its SQL in DuckDB."""

import glob
import os

import duckdb


def oracle_rows(sf: str, sql: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()


def normal(rows) -> list[str]:
    return sorted(repr(tuple(round(float(v), 5) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


def same(df, sf: str, sql: str) -> None:
    columns = sorted(df.columns)
    got = normal(tuple(r) for r in df.select(*columns).collect())
    want = normal(oracle_rows(sf, sql, columns))
    assert len(got) == len(want)
    assert got == want
