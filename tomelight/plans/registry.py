"""Registration of queries with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqlviews import sql as with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(body: str | None, *views: str, lists: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function under its name; ``body`` is its SQL over ``views`` and the driver's tables.

    Columns named in ``lists`` hold arrays of strings or numbers; the registered query joins them
    with bars, so that results compare as plain values.
    """

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def flat(spark: SparkSession, d: str) -> DataFrame:
            out = f(spark, d)
            for c in lists:
                out = out.withColumn(c, F.array_join(F.col(c).cast("array<string>"), "|"))
            return out

        QUERIES[f.__name__] = flat if lists else f
        if body is not None:
            text = with_views(body, *views)
            if lists:
                text = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, '|') AS {c}" for c in lists)}) FROM (\n{text}\n)"
            SQL[f.__name__] = text
        return f

    return add
