"""Side-by-side check of a registered query and its SQL: rows, columns and values, order aside."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("%.9g" % (v + 0.0))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return "%.9g" % v if abs(v) < 10**9 else str(v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, build, sql: str | None):
    began = time.time()
    df = build(spark, sf)
    mine = [tuple(r) for r in df.collect()]
    spent = time.time() - began
    if sql is None:
        return True, f"rows only: {len(mine)}", spent
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", spent
    a, b = _rows(df.columns, mine), _rows(names, theirs)
    if a == b:
        return True, f"{len(a)} rows", spent
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return False, f"{len(a)} vs {len(b)} rows; spark-only {only_a}; sql-only {only_b}", spent
