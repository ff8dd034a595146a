"""Compare a query's rows with those of its DuckDB SQL."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def assert_same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = con.execute(sql)
    own = [d[0] for d in result.description]
    assert sorted(own) == names
    want = sorted((tuple(plain(r[own.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert got == want
