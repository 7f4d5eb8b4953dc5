"""Run registered queries beside their SQL: python -m tests.oracle [folder] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


STATS: dict[str, float] = {}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def compare(spark, con, name, fn, sql, folder) -> str | None:
    """None when both sides agree, else what differs."""
    began = time.time()
    df = fn(spark, folder)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    STATS["spark"] = time.time() - began
    if sql is None:
        return None if rows else "no rows"
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    if sorted(theirs) != cols:
        return f"columns {cols} vs {sorted(theirs)}"
    at = [theirs.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    a, b = sorted(tuple(map(plain, r)) for r in rows), sorted(tuple(map(plain, r)) for r in want)
    if not rows:
        return "no rows"
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} vs {len(b)} rows; {cols}\n   spark {only_a}\n   sql   {only_b}"


def main(argv):
    from weft.plans import ORACLES, QUERIES
    from weft.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = build_session("local[8]"), connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        began = time.time()
        try:
            STATS.clear()
            diff = compare(spark, con, name, fn, ORACLES.get(name), folder)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        bad += diff is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'FAIL' if diff else 'ok  '} {name}{kind} {time.time() - began:.1f}s spark {STATS.get('spark', -1):.1f}s", flush=True)
        if diff:
            print("   " + diff, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
