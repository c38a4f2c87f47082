"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from corvina.plans import ORACLE, QUERIES
from corvina.session import TABLES


def norm(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "item"):
        return tuple(norm(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, pd.Timestamp) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE:
        return
    want = duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(norm(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]
