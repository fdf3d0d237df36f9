"""Every query over the tables against its SQL."""

import math

import pytest

from mergeloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, oracle):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in SQL:
        assert got.columns
        return
    rel = oracle.sql(SQL[name])
    assert sorted(rel.columns) == sorted(got.columns)
    names = sorted(got.columns)
    want = sorted(tuple(norm(v) for v in (r[rel.columns.index(c)] for c in names)) for r in rel.fetchall())
    have = sorted(tuple(norm(r[c]) for c in names) for r in rows)
    assert have == want


def test_all_have_names_of_their_own():
    assert set(SQL) <= set(QUERIES)
