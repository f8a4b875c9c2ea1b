"""Every registered query against its SQL, or a rows check where there is none."""

import __spark_entry__ as contract
import oracle
import pytest

SF = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    found = contract.queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert oracle.difference(found, duck.execute(SQL[name]).df()) is None
    else:
        assert len(found)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())
