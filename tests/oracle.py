"""Compare registered queries with their SQL on the same parquet files.

Run as a script for a report: ``python -m tests.oracle [--sf DIR] [names or areas ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
DEFAULT_DIR = "/root/testdata/sf0.01"


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    """One representation per value, whatever engine it came from."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def canon(table):
    names = sorted(table.column_names)
    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=repr) if columns else []


def same_sorted(got, want):
    """Exact equality of two tables after sorting, without leaving Arrow."""
    names = sorted(got.column_names)
    if names != sorted(want.column_names) or got.num_rows != want.num_rows:
        return False
    got, want = got.select(names), want.select(names)
    if [str(t).replace("large_", "") for t in got.schema.types] != [str(t).replace("large_", "") for t in want.schema.types]:
        return False
    order = [(n, "ascending") for n in names]
    return got.cast(want.schema, safe=True).sort_by(order).equals(want.sort_by(order))


def compare(spark, con, name, query, folder):
    """(ok, message, spark seconds)."""
    start = time.time()
    got = query(spark, folder).toArrow()
    took = time.time() - start
    if query.sql is None:
        return got.num_rows > 0, f"rows only: {got.num_rows}", took
    want = con.sql(query.sql).to_arrow_table()
    if same_sorted(got, want):
        return True, f"{got.num_rows} rows", took
    got_names, got_rows = canon(got)
    want_names, want_rows = canon(want)
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}", took
    if len(got_rows) != len(want_rows):
        return False, f"rows {len(got_rows)} != {len(want_rows)}", took
    if got_rows != want_rows:
        only_got = [r for r in got_rows if r not in set(want_rows)][:2]
        only_want = [r for r in want_rows if r not in set(got_rows)][:2]
        return False, f"{got_names}\n   spark {only_got}\n   sql   {only_want}", took
    kinds = {n: (str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in got_names}
    odd = {n: k for n, k in kinds.items() if k[0] != k[1] and not {*k} <= {"string", "large_string"}}
    return True, f"{len(got_rows)} rows" + (f"  types differ: {odd}" if odd else ""), took


def main() -> None:
    from millrace.plans import AREAS, load
    from millrace.session import local_session

    args = sys.argv[1:]
    folder = DEFAULT_DIR
    if "--sf" in args:
        at = args.index("--sf")
        folder = args[at + 1]
        del args[at:at + 2]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    import importlib
    if args:
        for a in args:
            if a in AREAS:
                importlib.import_module(f"millrace.plans.{a}")
            else:
                load()
        from millrace.plans.registry import REGISTRY as registry
    else:
        registry = load()
    bad = []
    for name, q in registry.items():
        area = q.build.__module__.rsplit(".", 1)[1]
        if args and name not in args and area not in args:
            continue
        try:
            ok, message, took = compare(spark, con, name, q, folder)
        except Exception as e:      # report every query, then fail
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {took:6.2f}s {message}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
