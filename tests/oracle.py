"""Run queries against their SQL twins in DuckDB.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} differ, first: {str(bad[0][0])[:600]} / {str(bad[0][1])[:600]}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from reqsieve.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    sqls = oracle_sql()
    failed = []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                why = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t0:.1f}s {why or ''}", flush=True)
        if why:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
