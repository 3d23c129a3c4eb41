"""The corpus queries against DuckDB, on whole tables."""

from collections import Counter

import duckdb
import pytest

from meldspark.llm.oracles import ORACLES
from meldspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "sales", "sale_lines", "clients"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    got = [tuple(r) for r in df.select(*want.columns).collect()]
    assert got
    assert Counter(map(str, got)) == Counter(map(str, want.fetchall()))
