"""Every query gives what its SQL gives, and something at all."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def _keys():
    from plumbline.plans.catalogue import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("key", _keys())
def test_query(spark, duck, key):
    from plumbline.plans.catalogue import ORACLES, QUERIES

    df = QUERIES[key](spark, DATA)
    cols = sorted(df.columns)
    assert key in ORACLES
    got = sorted(tuple(map(repr, r)) for r in df.select(*cols).collect())
    r = duck.sql(ORACLES[key])
    at = [r.columns.index(c) for c in cols]
    assert sorted(r.columns) == cols
    assert got and got == sorted(tuple(repr(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_detector_has_a_query():
    from plumbline.plans.catalogue import QUERIES
    from plumbline.plans.engine import DETECTORS

    assert set(DETECTORS) <= set(QUERIES)
