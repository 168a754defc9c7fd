"""Compare registered queries with their oracle SQL: ``python -m tests.oracle [sf_dir] [name part ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from sparklore.plans import all_queries
from sparklore.plans.registry import compose
from sparklore.session import local_session

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
                 "pages benchmark labels conversations").split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return ("f", float(f"{v:.9g}"))  # a float is not the integer of equal value
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr))


def oracle(sf_dir):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(q, spark, con, sf_dir):
    """'' if the query equals its oracle, else what differs."""
    from sparklore.plans.fixtures import Kb
    df = q.run(Kb(spark, sf_dir))
    cols, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return "" if rows else "no rows"
    cur = con.execute(compose(q.sql))
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if rows == want:
        return "" if rows else "EMPTY"
    left, right = set(rows), set(want)
    return (f"rows {len(rows)} vs {len(want)}; only spark {len(left - right)} "
            f"{str(sorted(left - right, key=repr)[:2])[:500]}; only sql {len(right - left)} "
            f"{str(sorted(right - left, key=repr)[:2])[:500]}")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con, bad = local_session(cpus=8), oracle(sf_dir), 0
    for name, q in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            why = compare(q, spark, con, sf_dir)
        except Exception as e:  # report and go on with the next query
            why = f"{type(e).__name__}: {str(e)[:900]}"
            if "-v" in parts:
                traceback.print_exc()
        bad += bool(why)
        print(f"{'ok ' if not why else 'BAD'} {name} {time.time() - t:.1f}s"
              f"{' (rows only)' if q.sql is None else ''} {why}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
