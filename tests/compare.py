"""Run a registered query and its SQL side by side."""

import glob
import math
import os

import duckdb

from fleetplan.registry.oracles import ORACLES, sql
from fleetplan.registry.queries import QUERIES


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        view = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return "null" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name):
    """None if both sides agree, else a short description of the difference."""
    df = QUERIES[name](spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    cursor = con.execute(sql(ORACLES[name]))
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    right = rows_of(columns, cursor.fetchall())
    if left == right:
        return None
    ours, theirs = set(left) - set(right), set(right) - set(left)
    return f"rows {len(left)} / {len(right)}; only ours {sorted(ours)[:3]}; only SQL {sorted(theirs)[:3]} ({len(ours)}, {len(theirs)})"
