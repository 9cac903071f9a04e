"""Runs a query in Spark and its SQL in DuckDB and compares rows."""

import datetime
import decimal
import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sql):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    r = con.sql(sql)
    columns = sorted(r.columns)
    return columns, ordered([tuple(row[r.columns.index(c)] for c in columns) for row in r.fetchall()])


def same(spark, query, sql):
    columns, expected = duck(sql)
    df = query(spark, SF)
    assert sorted(df.columns) == columns
    assert ordered(df.select(*columns).collect()) == expected
