"""Every query against its SQL twin, on the smallest tables; and none runs Python or a product of tables where functions do."""

from __future__ import annotations

import pytest

from gridquill.plans import registry
from tests.conftest import DATA, assert_same, plan


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    found = registry.QUERIES[name](spark, DATA)
    assert not any(x in plan(found) for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
    if name in registry.ORACLE_SQL:
        assert_same(found, registry.ORACLE_SQL[name])
    else:
        assert found.count() > 0
