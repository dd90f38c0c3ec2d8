"""Run a registered query and its SQL over one directory of tables and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    got = query(spark, sf_dir)
    a = rows(got.columns, [tuple(r) for r in got.collect()])
    rel = connect(sf_dir).sql(sql)
    b = rows(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        left, right = [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3]
        return f"{len(a[1])} and {len(b[1])} rows; only here {left}; only in SQL {right}"
    return ""
