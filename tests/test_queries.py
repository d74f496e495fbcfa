"""Every registered query against its SQL twin, and the driver contract."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

NAMES = list(queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    sqls = oracle_sql()
    if name in sqls:
        assert compare(spark, con, sf_dir, queries()[name], sqls[name]) is None
    else:
        assert queries()[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(NAMES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["request_id", "text", "anomaly_score", "is_anomaly", "confidence"]
    assert df.count() == 50
