"""Rows of a query and of its SQL as comparable lists."""

from __future__ import annotations

import glob
import math
import os

import duckdb

HERE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return int(v) if isinstance(v, int) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql: str, sf_dir: str = HERE) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())
