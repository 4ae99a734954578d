"""Compares a query with its DuckDB SQL, by sorted columns and rows."""

import math
import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "None"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 9) + 0.0)
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(df, connection, sql):
    found = connection.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
