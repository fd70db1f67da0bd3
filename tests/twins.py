"""Holds a query's rows against its DuckDB twin's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name, query, sql, d):
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM '{d}/{x}.parquet'")
    want = con.execute(sql).df()
    got = query(spark, d).toPandas()
    assert sorted(got.columns) == sorted(want.columns), (name, sorted(got.columns), sorted(want.columns))
    cols = sorted(got.columns)
    shape = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 6) if isinstance(v, float) else v if isinstance(v, (str, bool)) else str(v)
    rows = lambda f: sorted(repr(tuple(shape(v) for v in r)) for r in f[cols].astype(object).itertuples(index=False, name=None))
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (name, len(a), len(b))
    assert a == b, (name, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3])
    assert len(a) > 0, name
