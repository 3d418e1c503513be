from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tomelight.operators import records
from tomelight.sources import relations as R

SCHEMA = "id string, path string, n long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def all_of(spark, path, version=None):
    return sorted(map(tuple, R.read(spark, path, version).collect()), key=repr)


def test_insert_keeps_keys_unique(spark, tmp_path):
    path = str(tmp_path / "sources")
    assert R.read(spark, path) is None
    assert R.insert(spark, path, rows(spark, ("a", "x", 1), ("b", None, 2), ("c", None, 3)), [["id"], ["path"]]) == 1
    for bad in (("a", "y", 1), ("d", "x", 1)):
        with pytest.raises(R.NotUnique):
            R.insert(spark, path, rows(spark, bad), [["id"], ["path"]])
    with pytest.raises(R.NotUnique):
        R.insert(spark, path, rows(spark, ("e", "z", 1), ("e", "w", 2)), [["id"], ["path"]])
    assert all_of(spark, path) == [("a", "x", 1), ("b", None, 2), ("c", None, 3)]
    assert sorted(p.name for p in (tmp_path / "sources").iterdir() if p.name.startswith("v-")) == sorted(R.versions(spark, path).values())  # nothing half written stays


def test_last_write_wins_and_versions_stay_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    R.upsert(spark, path, rows(spark, ("a", "x", 1), ("a", "y", 3), ("a", "z", 2), ("b", "w", 1)), ["id"], "n")
    assert all_of(spark, path) == [("a", "y", 3), ("b", "w", 1)]
    assert R.upsert(spark, path, rows(spark, ("b", "v", 0), ("c", "u", 9)), ["id"]) == 2
    assert all_of(spark, path) == [("a", "y", 3), ("b", "v", 0), ("c", "u", 9)] and all_of(spark, path, 1) == [("a", "y", 3), ("b", "w", 1)]
    R.delete(spark, path, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert all_of(spark, path) == [("b", "v", 0), ("c", "u", 9)]
    for _ in range(3):
        R.upsert(spark, path, rows(spark, ("d", "t", 1)), ["id"])
    assert sorted(R.versions(spark, path)) == [4, 5, 6]


def test_a_writer_that_comes_late_starts_again(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    R.insert(spark, path, rows(spark, ("a", "x", 1)), [["id"]])

    def slow(now):
        calls.append(1)
        if len(calls) == 1:
            R.insert(spark, path, rows(spark, ("b", "y", 2)), [["id"]])  # another writer meanwhile
        return now.withColumn("n", F.col("n") + 10)

    assert R.write(spark, path, slow, [["id"]]) == 3
    assert len(calls) == 2 and all_of(spark, path) == [("a", "x", 11), ("b", "y", 12)]

    def never(now):
        R.upsert(spark, path, rows(spark, ("c", "z", 0)), ["id"])
        return now

    with pytest.raises(R.Contended):
        R.write(spark, path, never, [], tries=2)


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    R.insert(spark, path, rows(spark, ("first", None, 0)), [["id"]])
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda k: R.insert(spark, path, rows(spark, (f"w{k}", None, k)), [["id"]], tries=20), range(3)))
    assert sorted(done) == [2, 3, 4] and {r[0] for r in all_of(spark, path)} == {"first", "w0", "w1", "w2"}


def test_tasks_are_created_and_stored(spark, tmp_path):
    new = records.create_tasks(spark.createDataFrame([("why",), ("how",)], "brief string"), "2024-05-01T00:00:00.000Z")
    path = str(tmp_path / "tasks")
    R.insert(spark, path, new, [["id"]])
    got = R.read(spark, path).collect()
    assert {(r["brief"], r["status"], r["created_at"], r["updated_at"]) for r in got} == {(b, "created", *["2024-05-01T00:00:00.000Z"] * 2) for b in ("why", "how")}
    assert len({r["id"] for r in got}) == 2 and all(r["workspace_path"] == f"tasks/tsk-{r['id']}" for r in got)
