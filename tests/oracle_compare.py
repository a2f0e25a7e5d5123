"""Run registered queries in Spark and their SQL texts in DuckDB; compare the results.

``python tests/oracle_compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return value + 0.0
    return value


def _sortable(row):
    return [(value is None, str(type(value)), repr(value)) for value in row]


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=_sortable)


def spark_result(df):
    return normalised(df.columns, [tuple(row) for row in df.collect()])


def duck_result(con, sql):
    cursor = con.execute(sql)
    columns = [item[0] for item in cursor.description]
    return normalised(columns, cursor.fetchall())


def difference(left, right) -> str | None:
    """None when equal, otherwise a short description."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}"
    return None


def main(argv):
    from orderlens.session import build_session
    from orderlens.plans import oracle, registry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls, failed = oracle.oracle_sql(), 0
    for name, run in registry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            got = spark_result(run(spark, sf_dir))
            seconds = time.time() - started
            if name in sqls:
                started = time.time()
                note = difference(got, duck_result(con, sqls[name]))
                status = "ok" if note is None else f"DIFF {note}"
                status += f" (sql {time.time() - started:.1f}s)"
            else:
                status, note = f"rows only: {len(got[1])} {got[0]} {got[1][:2]}", None
        except Exception as error:  # report and go on with the next query
            seconds, note = time.time() - started, "error"
            status = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += note is not None
        print(f"{name:32s} {seconds:6.2f}s {status}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
