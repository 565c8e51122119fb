"""Run a query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return format(v, ".9g") if v != int(v) or abs(v) > 1e15 else format(float(v), ".9g")
    if isinstance(v, int):
        return format(float(v), ".9g") if abs(v) < 2**53 else str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows, cell=_cell):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def _typed(v):
    """Exact value and type family, to see what only a tolerant comparison hides."""
    if isinstance(v, dt.datetime):
        return "ts:" + v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v!r}"


def compare(spark, con, q, sf_dir: str, notes: list | None = None, allow_empty: bool = False) -> str | None:
    """None when equal, else what differs."""
    df = q.run(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    got_cols, got = rows_of(df.columns, got_rows)
    if q.oracle is None:
        return None if got or allow_empty else "no rows"
    cur = con.execute(q.oracle)
    want_rows = cur.fetchall()
    want_cols, want = rows_of([d[0] for d in cur.description], want_rows)
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if not want and not allow_empty:
        return "oracle has no rows"
    if got != want:
        got_set, want_set = set(got), set(want)
        extra = [r for r in got if r not in want_set][:3]
        lost = [r for r in want if r not in got_set][:3]
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lost}"
    if notes is not None:
        _, g = rows_of(df.columns, got_rows, _typed)
        _, w = rows_of([d[0] for d in cur.description], want_rows, _typed)
        if g != w:
            i = next(i for i, (a, b) in enumerate(zip(g, w)) if a != b)
            notes.append(f"inexact {sum(a != b for a, b in zip(g, w))}/{len(g)}: {g[i]} vs {w[i]}")
    return None
