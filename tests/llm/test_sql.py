"""The registered queries that SQL can express against their SQL, run by another engine on the same files."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SF
from tomelight.llm import queries
from tomelight.session import ship


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](ship(spark), SF), duck.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))
