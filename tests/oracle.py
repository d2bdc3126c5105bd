"""Runs a query and its SQL over the same tables and compares rows without their order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (datetime, date)):
        return x
    if isinstance(x, (int, Decimal)) or (isinstance(x, float) and x.is_integer()):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(columns, found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def compare(spark, sf_dir, query, sql) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    theirs = rows(columns, out.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if mine != theirs:
        return f"{sum(mine.values())} rows against {sum(theirs.values())}; only here {list((mine - theirs).items())[:3]}; only in SQL {list((theirs - mine).items())[:3]}"
    return "" if mine else "no rows"
