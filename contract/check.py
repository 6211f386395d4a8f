"""Compare registered queries with their SQL counterparts on one data folder.

    python -m contract.check [folder] [query,query..]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from contract.oracle import ORACLE
from contract.queries import REGISTRY
from skein.session import local_session


def open_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def table(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(name: str, spark, con, sf_dir: str) -> str | None:
    """None when equal, else the first difference."""
    mine = REGISTRY[name](spark, sf_dir)
    got = table(mine.columns, [tuple(r) for r in mine.collect()])
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = table(names, cursor.fetchall())
    if sorted(mine.columns) != sorted(names):
        return f"columns {sorted(mine.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    different = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(different)} of {len(got)} rows, first {different[0]}" if different else None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(ORACLE)
    spark, con = local_session("check", "8"), open_views(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(name, spark, con, sf_dir)
        except Exception as error:  # report every query, not only the first failure
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
