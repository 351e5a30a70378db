"""Holding a query's rows against DuckDB."""

import math
import os

import duckdb


def rows_of(values):
    plain = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    return sorted((tuple(map(plain, row)) for row in values), key=repr)


def views(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + "/*.parquet" * os.path.isdir(f"{folder}/{name}")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{path}'")
    return con


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    expected = [[row[i] for i in order] for row in found.fetchall()]
    position = {c: i for i, c in enumerate(df.columns)}
    got = [[row[position[names[i]]] for i in order] for row in df.collect()]
    assert rows_of(got) == rows_of(expected)
