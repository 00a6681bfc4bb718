"""Comparison of a query with its SQL over the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def database(sf_dir: str = SF):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if hasattr(x, "item") and not isinstance(x, np.ndarray):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}"
    return str(x)


def rows(frame, columns):
    return sorted(tuple(cell(x) for x in row) for row in frame[columns].itertuples(index=False))


def assert_same(found, expected):
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert rows(found, columns) == rows(expected, columns)
