"""Run a registered query on Spark and its SQL on DuckDB and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(plain(r[i]) for i in order) for r in rows
    )


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    found = con.execute(sql)
    names, expected = rows_of([d[0] for d in found.description], found.fetchall())
    got_names, got = rows_of(df.columns, df.collect())
    if names != got_names:
        return f"columns {got_names} != {names}"
    if got != expected:
        more, less = list((got - expected).items())[:3], list((expected - got).items())[:3]
        return (
            f"{sum(got.values())} rows, expected {sum(expected.values())}, "
            f"{sum((got - expected).values())} differ\n  spark:  {str(more)[:600]}\n  duckdb: {str(less)[:600]}"
        )
    return ""


def main(argv):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
    import __spark_entry__ as entry
    from plumbline.session import local_session

    folder = argv[0]
    names = argv[1:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = "" if df.count() >= 0 else "no rows"
        except Exception as error:  # report every query, then go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += bool(problem)
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    print(f"{len(names)} queries, {bad} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
