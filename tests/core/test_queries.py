"""Every registered query of the core against its SQL at the smallest size."""

import pytest

from tests.core.oracle import connect, differences
from tidegrid.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["wrmsse"] > 0
