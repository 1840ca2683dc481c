"""Every registered query of the scan engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from platen.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return None if math.isnan(x) else f"{x + 0.0:.9g}"
    return str(x)


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


def sorted_numbers(frame, columns):
    """All-numeric rows as one sorted array: the quick way for rasters."""
    a = np.column_stack([frame[c].astype("float64").to_numpy() for c in columns])
    return a[np.lexsort(a.T[::-1])]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    if len(ours) > 50_000 and all(pd.api.types.is_numeric_dtype(ours[c]) for c in columns):
        assert len(ours) == len(theirs) and np.allclose(sorted_numbers(ours, columns), sorted_numbers(theirs, columns), rtol=1e-9, equal_nan=True)
        return
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
