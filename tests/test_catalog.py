"""Every calendar query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fairgrid.plans import catalog
from fairgrid.plans.views import TABLES


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        return repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)

    return sorted(([plain(v) for v in row] for row in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, small, name):
    got = catalog.queries()[name](spark, small)
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = got.toPandas(), want
    for c in got:  # integers with nulls come as floats from one side
        if pd.api.types.is_float_dtype(got[c]) and pd.api.types.is_integer_dtype(want[c]):
            want[c] = want[c].astype("float64")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["geocode_cascade", "prefix_suggestions"])
def test_repeated_names_and_codes_equal_sql(spark, small, tmp_path, name):
    con = duckdb.connect()
    for t in TABLES:
        key = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}.get(t)
        asks = f"case {key} when 5 then 5000 when 6 then 5004 else {key} end"  # for the ZIP codes 10000 and 10008, which ten keys from 100000 on have
        table = f"select * replace ({asks} as {key}) from '{small}/{t}.parquet' union all select * replace ({key} + 100000 as {key}) from '{small}/{t}.parquet'" if key else f"from '{small}/{t}.parquet'"
        con.sql(f"copy ({table}) to '{tmp_path}/{t}.parquet'")
        con.sql(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert (want["query_id"] == {"prefix_suggestions": 5000, "geocode_cascade": 5004}[name]).sum() == 10
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
