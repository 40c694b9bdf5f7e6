"""Every query against its SQL in DuckDB, as rows in any order."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from terrakiln.plans.oracles import ORACLES
from terrakiln.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def ordered(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or df[c].map(type).astype(str).str.contains("date").any():
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind in "iufb":
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], rtol=0, atol=1e-9, err_msg=c)
        else:
            assert got[c].fillna("").tolist() == want[c].fillna("").tolist(), c
