"""Every registered query with SQL gives the SQL's rows; the others run."""

import pytest

from quarry.plans import registry

QUERIES, ORACLES = registry.collect("QUERIES"), registry.collect("ORACLES")


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, oracle):
    got = QUERIES[name](spark, data)
    rows = got.collect()
    if name not in ORACLES:
        assert rows
        return
    columns, want = oracle(ORACLES[name])
    assert sorted(columns) == sorted(got.columns)
    order = sorted(got.columns)
    key = lambda r: tuple(repr(round(x, 3) if isinstance(x, float) else x) for x in r)
    left = sorted((tuple(r[c] for c in order) for r in rows), key=key)
    right = sorted((tuple(r[columns.index(c)] for c in order) for r in want), key=key)
    assert len(left) == len(right)
    assert all(same(x, y) for a, b in zip(left, right) for x, y in zip(a, b))


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
