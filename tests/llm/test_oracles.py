"""The corpus queries with SQL give the same rows in DuckDB."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from parlance.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want, got = c.sql(Q.oracle_sql()[name]).df(), Q.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    text = lambda d: sorted(tuple("" if pd.isna(x) else str(float(x)) if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x) for x in r) for r in d[cols].itertuples(index=False))
    assert text(want) == text(got)
