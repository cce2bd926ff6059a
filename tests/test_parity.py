"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import pytest

from rollkeep import catalog
from tests.parity import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert differences(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], duck) == ""


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
