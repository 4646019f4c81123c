"""Comparison of a query with its SQL."""

from numbers import Number

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or (not isinstance(v, list) and pd.isna(v)) else v for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=repr)


def rounded(rows):
    number = lambda v: isinstance(v, Number | np.number) and not isinstance(v, bool | np.bool_)
    return sorted([tuple(round(float(v), 5) if number(v) else str(v) for v in r) for r in rows], key=repr)
