"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_names_and_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) >= 85
    assert entry.entry(spark).columns == ["window_id", "mean_psi", "severity"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    oracles = entry.oracle_sql()
    if name in oracles:
        why = compare(got, duck.execute(oracles[name]).df())
        assert why is None or why.startswith("~"), why
    else:
        assert len(got)
