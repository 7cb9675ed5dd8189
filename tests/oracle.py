"""Compare a Spark result with DuckDB over the same folder, regardless of order."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in pathlib.Path(folder).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    done = con.execute(sql)
    return table_rows([d[0] for d in done.description], done.fetchall())


def spark_rows(df):
    return table_rows(df.columns, [tuple(r) for r in df.collect()])
