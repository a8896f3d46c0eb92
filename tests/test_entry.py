"""Every registered query of the engine against its oracle at the smallest scale."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tidewheel import workload

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def normal(df):
    cols = sorted(df.columns)

    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 4) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return cols, sorted((tuple(one(v) for v in row) for row in df[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", list(workload.ORACLES))
def test_oracle(spark, duck, name):
    have, want = normal(workload.QUERIES[name](spark, D).toPandas()), normal(duck.sql(workload.ORACLES[name]).df())
    assert have[0] == want[0] and len(have[1]) == len(want[1])
    for x, y in zip(have[1], want[1], strict=True):
        for a, b in zip(x, y, strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-4, abs=2e-4), (x, y)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["user_id", "field", "ts", "value"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
