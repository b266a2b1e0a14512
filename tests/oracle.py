"""Compare every registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != int(value or 0) else str(int(value)) if not math.isinf(value) else str(value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat() + " 00:00:00"
    return str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) if not isinstance(row[i], float) or not math.isinf(row[i]) else "inf" for i in order) for row in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not want:
        return "both are empty"
    a, b = rows_of(got, df.columns), rows_of(want, columns)
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"first difference {x} vs {y}"
    return None


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from eventloom.session import get_session

    # usage: oracle.py [folder] [--max-rows N] [names...]; a small N forces the sliced layout everywhere
    arguments = sys.argv[1:]
    limit = None
    if "--max-rows" in arguments:
        at = arguments.index("--max-rows")
        limit = arguments[at + 1]
        del arguments[at : at + 2]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    only = set(arguments[1:])
    spark = get_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("OFF")
    if limit:
        spark.conf.set("spark.eventloom.maxRowsPerKey", limit)
    con, sql = connect(folder), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, fn, sql.get(name))
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s{'' if name in sql else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{bad} failures")
