"""Holds a registered query against its SQL on DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet' )" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> int:
    con = connect(sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows_of(names, got.fetchall())
    have = rows_of(df.columns, df.collect())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    assert len(have) == len(want), f"{len(have)} rows, the SQL has {len(want)}; e.g. {set(map(repr, have)) ^ set(map(repr, want)) and sorted(set(map(repr, have)) ^ set(map(repr, want)))[:4]}"
    odd = [(h, w) for h, w in zip(have, want) if h != w]
    assert not odd, f"{len(odd)} rows differ, e.g. {odd[:2]}"
    return len(have)
