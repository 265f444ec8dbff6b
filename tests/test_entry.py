"""Driver contract: entry runs, every query of the catalog has an oracle, and
every one runs to its last row at sf0.001."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from paygrid.plans.catalog import REGISTRY
from tests.conftest import SF001


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "current_cost" in df.columns


def test_every_query_has_oracle():
    assert set(REGISTRY) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_runs(spark, name):
    queries()[name](spark, SF001).write.format("noop").mode("overwrite").save()
