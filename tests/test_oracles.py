"""Every registered query of the library proper against its SQL, run by another engine on the same files."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SF
from tomelight import catalog
from tomelight.session import ship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in data)


def test_every_query_has_sql():
    # Stemming and snippets have no SQL; tests/test_records.py and tests/test_match.py hold them against another engine's index.
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"fts_search_stemmed", "fts_snippet"}
    assert catalog.FLAGSHIP in catalog.queries()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](ship(spark), SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
