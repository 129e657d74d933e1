"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from caseloom import catalog
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, key):
    notes = compare(catalog.queries()[key](spark, SF), con, catalog.oracle_sql()[key])
    assert notes == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_id", "name", "entity_type", "score", "evidence_count"]
    assert df.count() > 0
