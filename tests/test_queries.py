"""Every registered query against its SQL, or for rows if it has none."""

from __future__ import annotations

import pytest
from conftest import SF

from leakloom.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same_as_sql, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same_as_sql(df, ORACLES[name])
    else:
        assert df.count() > 0
