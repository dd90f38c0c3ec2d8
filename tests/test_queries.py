"""Every registered vendor-risk query against its SQL."""

from __future__ import annotations

import pytest
from compare import differences

from vendorlens.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], sf_dir) == ""
