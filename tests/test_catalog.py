"""Every registered query against its DuckDB form."""

import pytest

from barspark.catalog import load

from .compare import compare, duck

REGISTRY = load()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(REGISTRY.QUERIES))
def test_query(spark, sf, con, name):
    rows, verdict = compare(spark, con, REGISTRY.QUERIES[name], REGISTRY.SQL.get(name), sf)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_names_are_plain():
    for name in REGISTRY.QUERIES:
        assert name.replace("_", "").isalnum() and not name.startswith("op")
    assert set(REGISTRY.SQL) <= set(REGISTRY.QUERIES)
