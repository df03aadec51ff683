"""Run every registered query beside its SQL and compare rows, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool) or value is None:
        return (type(value).__name__, str(value))
    if isinstance(value, int):
        return ("int", str(value))
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, datetime.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    return (type(value).__name__, str(value))


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, folder: str) -> tuple[str, str]:
    df = entry.queries()[name](spark, folder)
    spark_names, spark_rows = table(df.columns, [tuple(row) for row in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("rows", str(len(spark_rows)))
    cursor = con.execute(sql)
    names, rows = table([c[0] for c in cursor.description], cursor.fetchall())
    if names != spark_names:
        return ("differs", f"columns {spark_names} / {names}")
    if len(rows) != len(spark_rows):
        return ("differs", f"rows {len(spark_rows)} / {len(rows)}")
    odd = [(a, b) for a, b in zip(spark_rows, rows) if a != b]
    if odd:
        return ("differs", f"{len(odd)} of {len(rows)} rows, first {odd[0]}")
    return ("equal", str(len(rows)))


if __name__ == "__main__":
    from gaugework.session import local_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    session = local_session()
    con = oracle_connection(where)
    for query_name in wanted:
        begun = time.time()
        try:
            outcome = compare(session, con, query_name, where)
        except Exception as error:
            outcome = ("failed", f"{type(error).__name__}: {str(error)[:600]}")
        session.catalog.clearCache()
        print(f"{outcome[0]:8} {query_name:24} {time.time() - begun:6.1f}s {outcome[1][:700]}", flush=True)
