"""Every query with SQL gives the same rows in DuckDB."""

import pytest

from mnemosa.plans import data_queries, memory_queries, store_queries
from tests.oracle import compare

MODULES = (data_queries, memory_queries, store_queries)
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
ALL = {k: (q, SQL.get(k)) for m in MODULES for k, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, small, name):
    query, sql = ALL[name]
    if sql is None:
        query(spark, small).count()
        return
    rows, ours, theirs, names = compare(spark, small, query, sql)
    assert not names and not ours and not theirs, (rows, list(ours)[:3], list(theirs)[:3])
