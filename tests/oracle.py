"""Compare a query with its SQL in DuckDB on the same tables, whatever the order of rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def rows_of(frame):
    def shown(x):
        if pd.isna(x):
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).removesuffix(" 00:00:00")

    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def assert_same(df, sql, sf_dir):
    want, got = run_sql(sql, sf_dir), df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
