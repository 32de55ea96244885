"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb


def connect(folder):
    db = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        db.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)


def wanted(db, sql):
    run = db.execute(sql)
    names = [d[0] for d in run.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in run.fetchall()), key=repr)
