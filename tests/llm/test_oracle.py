"""Queries of the operators against their SQL counterparts, on the smallest tables."""

import pytest

from contract.check import open_views, table
from skein.llm.oracle import ORACLE
from skein.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, sf_dir):
    mine = REGISTRY[name](spark, sf_dir)
    cursor = open_views(sf_dir).execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(mine.columns)
    assert table(mine.columns, [tuple(r) for r in mine.collect()]) == table(names, cursor.fetchall())
