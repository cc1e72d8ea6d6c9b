"""Run every ``queries()`` entry in Spark and its ``oracle_sql()`` in DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Reports per query: row counts, column names, Spark vs DuckDB types, and whether
the order-insensitive multisets of rows are equal exactly / with float tolerance.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import get_session  # noqa: E402
from shelfwise.sources.raw import RAW_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v, approx: bool):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") if approx else v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, approx) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x, approx) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, approx)) for k, x in v.items()))
    return v


def rows_of(cols, rows, approx):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return Counter(tuple(norm(r[i], approx) for i in order) for r in rows)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    spark = get_session(master="local[4]", shuffle_partitions=8, driver_memory="8g")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    report = {}
    for name, fn in qs.items():
        if name not in (only or sqls):
            continue
        rec = {}
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            scols = sdf.columns
            stypes = [f.dataType.simpleString() for f in sdf.schema.fields]
            srows = [tuple(r) for r in sdf.collect()]
            rec["spark_rows"] = len(srows)
            rec["spark_sec"] = round(time.time() - t0, 2)
        except Exception as e:  # noqa: BLE001
            rec["spark_error"] = str(e).splitlines()[0][:600]
            report[name] = rec
            print(name, json.dumps(rec), flush=True)
            continue
        if name in sqls:
            try:
                res = con.execute(sqls[name])
                dcols = [d[0] for d in res.description]
                dtypes = [str(d[1]) for d in res.description]
                drows = res.fetchall()
                rec["duck_rows"] = len(drows)
                rec["cols_match"] = sorted(c.lower() for c in scols) == sorted(c.lower() for c in dcols)
                if not rec["cols_match"]:
                    rec["spark_cols"] = scols
                    rec["duck_cols"] = dcols
                tmap = dict(zip([c.lower() for c in dcols], dtypes))
                rec["types"] = {c: (t, tmap.get(c.lower())) for c, t in zip(scols, stypes)}
                rec["exact"] = rows_of(scols, srows, False) == rows_of(dcols, drows, False)
                rec["approx"] = rec["exact"] or rows_of(scols, srows, True) == rows_of(dcols, drows, True)
                if not rec["approx"]:
                    a, b = rows_of(scols, srows, True), rows_of(dcols, drows, True)
                    rec["only_spark"] = [str(x)[:300] for x in list((a - b).elements())[:3]]
                    rec["only_duck"] = [str(x)[:300] for x in list((b - a).elements())[:3]]
            except Exception as e:  # noqa: BLE001
                rec["duck_error"] = str(e).splitlines()[0][:600]
        else:
            rec["oracle"] = "none"
        report[name] = rec
        short = {k: v for k, v in rec.items() if k != "types"}
        print(name, json.dumps(short, default=str), flush=True)
    out = os.environ.get("ORACLE_REPORT")
    if out:
        with open(out, "w") as f:
            json.dump(report, f, indent=1, default=str)
    spark.stop()


if __name__ == "__main__":
    main()
