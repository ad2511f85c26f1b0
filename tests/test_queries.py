from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from standscan.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "lineitem", "orders")


def canonical(df):
    cols = sorted(df.columns)
    plain = df[cols].map(lambda v: "null" if v is None or v != v else f"{float(v):.4f}" if isinstance(v, (int, float)) else str(v))
    return sorted(map(tuple, plain.to_numpy().tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_sql(spark, name):
    got = core.queries()[name](spark, SF).toPandas()
    if name in core.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        want = con.execute(core.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
