"""Run a query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set threads to 2")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f if f.is_file() else f / '*.parquet'}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def plain(rows: list[tuple], order: list[int]) -> list[tuple]:
    def one(x):
        if isinstance(x, bool) or x is None:
            return x
        return float(x) if isinstance(x, (int, float)) else x

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sf_dir: str, sql: str, exact: bool = False) -> None:
    names, expected = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    got = plain([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(names)])
    want = plain(expected, [names.index(c) for c in sorted(names)])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or not exact and isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-8), (g, w)
