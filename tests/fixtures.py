"""Comparison of queries with their SQL, and hard variants of the test tables."""

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(folder):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(norm(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def sql_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], Counter(norm(tuple(r[i] for i in order)) for r in rel.fetchall())


#: Columns that are unique by definition.
UNIQUE = {"delivery_id", "row_id", "doc_id", "file_id", "event_id"}


def variant(folder, kind):
    """The tables emptied, with nulls in about a sixth of all values and repeated rows and extra columns, or the same with nulls in unique columns too."""
    con = connect(DATA)
    folder.mkdir(parents=True, exist_ok=True)
    for p in sorted(DATA.glob("*.parquet")):
        cols = [r[0] for r in con.sql(f"describe {p.stem}").fetchall()]
        if kind == "empty":
            con.sql(f"copy (select * from {p.stem} where false) to '{folder / p.name}' (format parquet)")
            continue
        spare = UNIQUE if kind == "nulls" else set()
        exprs = [f'"{c}"' if c in spare else f"case when hash(rowid_ * {97 + i}) % 6 <> 0 then \"{c}\" end as \"{c}\"" for i, c in enumerate(cols)]
        repeat = "" if spare & set(cols) else f" union all (select * from {p.stem} limit 25)"
        src = f"(select *, row_number() over () rowid_ from (select * from {p.stem}{repeat}))"
        con.sql(f"copy (select {', '.join(exprs)}, 'x' as bucket, 1 as \"_copies\", 2 as h, 'y' as _e from {src}) to '{folder / p.name}' (format parquet)")
    return str(folder)
