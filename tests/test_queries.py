"""Every query with an oracle against DuckDB; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [q for q in OWN if q in ORACLES])
def test_oracle(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == duck_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", [q for q in OWN if q not in ORACLES])
def test_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
