"""Every query with SQL gives DuckDB's rows over the smallest tables; the others run."""

from __future__ import annotations

import oracle
import pytest

from quire.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.ORACLE:
        assert oracle.difference(df, con, catalogue.ORACLE[name]) == ""
    else:
        assert df.count() > 0
