"""Every registered check on sf0.001 against its SQL oracle (DuckDB), plus
the entry contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from changeflow.catalog import QUERIES as CATALOG
from changeflow.catalog import load_all
from changeflow.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
load_all()
QUERIES = dict(CATALOG)
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except Exception:
        pass
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if hasattr(v, "isoformat") and not isinstance(v, str):
        import pandas as pd
        return pd.Timestamp(v).isoformat()
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)),
                        key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["user_id", "event_type", "value"]


def test_every_operator_has_oracle_or_is_listed():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, con, name):
    sdf = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(sdf) >= 0
        return
    odf = con.execute(ORACLE[name]).fetchdf()
    assert _rows(sdf) == _rows(odf)
