"""Every registered query against its check SQL on the smallest tables."""

import pytest
from compare import check, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def engine(data):
    return duck(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, engine, data, name):
    message, _, _ = check(spark, engine, name, QUERIES[name], ORACLES.get(name), data)
    assert message is None, message


def test_entry_is_the_flagship(spark, data):
    assert {"mail_id", "confidence", "risk_level"} <= set(entry.entry(spark).columns)
