"""Compares a query's rows with those of its DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str):
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return [("columns", spark_df.columns, names)]
    if len(got) != len(want):
        return [("rows", len(got), len(want))]
    return [(a, b) for a, b in zip(got, want) if a != b]
