"""Holds a Spark result against DuckDB's on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS FROM '{p}'")
    return con


def cell(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def differences(df, con, sql):
    """Nothing if both have the same columns and rows, else a short account."""
    rel = con.sql(sql)
    mine, theirs = df.columns, rel.columns
    if sorted(mine) != sorted(theirs):
        return f"columns {sorted(mine)} and {sorted(theirs)}"
    a, b = rows(mine, df.collect()), rows(theirs, rel.fetchall())
    if a == b:
        return ""
    own, other = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in other][:2]} and {[x for x in b if x not in own][:2]}"
