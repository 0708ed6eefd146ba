"""Every query of the catalog runs at the smallest size, and equals its SQL where it has one."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pytest

from framesift.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(map(plain, v))
        if v is None or v != v:
            return None
        return round(float(v), 5) if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v

    return sorted((tuple(map(plain, r)) for r in pdf.astype(object).where(pdf.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
