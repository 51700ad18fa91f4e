from __future__ import annotations

import pytest

from bidlake import catalog
from tests.oracle import SMALL, connection, differences


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert not differences(catalog.queries()[name](spark, SMALL), connection(), catalog.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
