"""Every registered query runs; those with SQL agree with it on the smallest tables."""

import pytest

from oracle import compare, duck

SF = "/root/testdata/sf0.001"


def _registry():
    import __spark_entry__ as entry

    return entry.queries(), entry.oracle_sql()


QUERIES, ORACLES = _registry()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem == ""  # no rows is a problem as well


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["paper_id", "picked_by", "url", "why", "score", "confidence"]
    assert df.count() > 0
