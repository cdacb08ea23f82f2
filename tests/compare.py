"""Run named queries in Spark and their SQL in DuckDB on the same tables and compare.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import signal
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, oracle, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(oracle)
    cols = [c[0] for c in cur.description]
    want_rows = cur.fetchall()
    t2 = time.time()
    message = f"{name}: {len(got_rows)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"{message} COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    got, want = rows_of(df.columns, got_rows), rows_of(cols, want_rows)
    if got == want:
        return True, message
    seen, expected = set(got), set(want)
    only_got = [r for r in got if r not in expected][:3]
    only_want = [r for r in want if r not in seen][:3]
    return False, f"{message} want {len(want)} rows; {sorted(cols)}\n   spark {only_got}\n   sql   {only_want}"


def main() -> int:
    from newsflow.plans import ORACLES, QUERIES
    from tests.session import session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    bad = 0

    def late(*_):
        raise TimeoutError("over 120 s")

    signal.signal(signal.SIGALRM, late)
    for name in args or list(QUERIES):
        try:
            signal.alarm(120)
            if name in ORACLES:
                ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                t0 = time.time()
                n = len(QUERIES[name](spark, sf_dir).collect())
                ok, message = True, f"{name}: {n} rows, spark {time.time() - t0:.1f}s (rows only)"
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{name}: {type(e).__name__} {str(e)[:700]}"
        finally:
            signal.alarm(0)
        bad += not ok
        print("ok  " if ok else "FAIL", message, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
