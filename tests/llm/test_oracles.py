"""The registered queries against their SQL, run by DuckDB over the same files."""

import duckdb
import pandas as pd
import pytest

from changeflow.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(tuple(None if pd.isna(v) else v for v in r) for r in df[columns].itertuples(index=False, name=None))
            for df in (got.convert_dtypes(), want.convert_dtypes())]
    assert rows[0] == rows[1]
