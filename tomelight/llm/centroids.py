"""Centroid clustering of integer vectors with exact arithmetic.

Components become integers, so squared distances and sums are integers too.  Distances come from
|x|² - 2x·c + |c|² with one matrix product a block, in double precision: as long as bounds on the
components keep every partial sum below 2**53, all of it is exact.  Rows or centroids beyond those
bounds are computed in 64-bit integers, and beyond these in integers of any size.  Sums of a round
are exact as well, whatever order ``treeAggregate`` adds them in, so results do not depend on
partitions.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fill_cores

#: Rows of one matrix product.
BLOCK_ROWS = 8192
#: Rows at a time in integers of any size.
_FEW_ROWS = 64
_LONG = np.iinfo(np.int64).max

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])


def largest_component(dims: int, bits: int) -> int:
    """The largest component for which |x|², 2x·c and |c|² together stay below 2**bits."""
    return math.isqrt((1 << bits) // dims) // 2 - 1


class Centres:
    """Integer centroids, in classes by what their distances can be computed in."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.dims = len(rows[0])
        self.tops = [max(map(abs, r), default=0) for r in rows]
        self.limits = (largest_component(self.dims, 53), largest_component(self.dims, 63))
        kinds = [sum(t > m for m in self.limits) for t in self.tops]
        self.numbers = [np.array([c for c, k in enumerate(kinds) if k == kind], np.int64) for kind in range(3)]

    def __getstate__(self) -> dict:
        return {"rows": self.rows}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["rows"])

    @cached_property
    def floats(self) -> tuple[np.ndarray, np.ndarray]:
        """Centroids of the first class as columns, and their squared lengths."""
        c = np.array([self.rows[n] for n in self.numbers[0]], float).reshape(-1, self.dims).T.copy()
        return c, (c * c).sum(axis=0)

    def by_product(self, x: np.ndarray) -> np.ndarray:
        c, squares = self.floats
        found = x @ c
        found *= -2.0
        found += (x * x).sum(axis=1)[:, None]
        found += squares
        return found.astype(np.int64)

    def by_long(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.stack([((x - np.array(self.rows[n], np.int64)) ** 2).sum(axis=1) for n in numbers], axis=1)

    def by_any(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        c = np.array([self.rows[n] for n in numbers], object)
        out = [np.zeros((0, len(numbers)), object)]
        for a in range(0, len(x), _FEW_ROWS):
            out.append(((exact(x[a : a + _FEW_ROWS])[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        return np.concatenate(out)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the number of the nearest centroid, the smallest of equally near ones, and the squared distance."""
        tops = np.abs(x).max(axis=1, initial=0)
        cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        classes = sum((tops > m).astype(int) for m in self.limits)
        for kind in range(3):
            rows = np.flatnonzero(classes == kind)
            if len(rows):
                cluster[rows], distance[rows] = self._nearest(x[rows], kind, tops[rows].max())
        return cluster, distance

    def _nearest(self, x: np.ndarray, kind: int, top: float) -> tuple[np.ndarray, np.ndarray]:
        best = None
        at = np.arange(len(x))
        for own, numbers in enumerate(self.numbers):
            if own == 2 and kind < 2 and best is not None:  # such a centroid is too far in one component alone, if beyond the farthest row's distance
                reach = int(top) + math.isqrt(int(best[1].max()))
                numbers = np.array([n for n in numbers if self.tops[n] <= reach], np.int64)
            if not len(numbers):
                continue
            worst = max(kind, own)
            found = self.by_product(x) if not worst else self.by_long(x, numbers) if worst == 1 else self.by_any(x, numbers)
            j = found.argmin(axis=1)
            now = numbers[j], found[at, j]
            if best is None:
                best = now
            else:
                nearer = ((now[1] < best[1]) | ((now[1] == best[1]) & (now[0] < best[0]))).astype(bool)
                best = np.where(nearer, now[0], best[0]), np.where(nearer, now[1], best[1])
        return best

    def sums(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The rows of each cluster added up, in integers of any size."""
        total = np.zeros((len(self.rows), self.dims), object)
        small = np.abs(x).max(axis=1, initial=0) <= self.limits[0]
        one = np.zeros((len(self.rows), int(small.sum())))
        one[cluster[small], np.arange(one.shape[1])] = 1.0
        total += exact(one @ x[small])
        for row, c in zip(exact(x[~small]), cluster[~small], strict=True):
            total[c] += row
        return total


def exact(x: np.ndarray) -> np.ndarray:
    """Doubles that hold integers as Python's integers."""
    out = np.empty(x.shape, object)
    out[...] = np.frompyfunc(int, 1, 1)(x) if x.size else x
    return out


def usable(df: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the rows whose vector has ``dims`` components, none null or not finite once multiplied by ``scale``."""
    own = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    most = F.lit(np.finfo(float).max / scale)
    return own.filter((F.size("v") == dims) & (F.size(F.array_compact("v")) == dims) & (F.array_max("v") <= most) & (F.array_min("v") >= -most))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(a, BLOCK_ROWS)
            yield part, np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * scale)


def _combined(kept: DataFrame, centres: Centres, scale: float, inertia: bool):
    """Per cluster the sums of rows and their number, or with ``inertia`` the sums of distances; added up by ``treeAggregate``."""
    dims, k = centres.dims, len(centres.rows)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, 1 if inertia else dims), object), np.zeros(k, np.int64)
        for _, x in _blocks(batches, dims, scale):
            cluster, distance = centres.nearest(x)
            counts += np.bincount(cluster, minlength=k)
            if inertia:
                np.add.at(sums[:, 0], cluster, distance)
            else:
                sums += centres.sums(x, cluster)
        yield pa.record_batch([pa.array([pickle.dumps((sums, counts))], pa.binary())], names=["state"])

    def add(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    parts = kept.mapInArrow(partial, "state binary").rdd.map(lambda row: pickle.loads(row[0]))
    return parts.treeAggregate(None, add, add, 2)


def seeds(kept: DataFrame, k: int, scale: float, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``salt:vec_id``; equal ones in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[math.floor(scale * x) for x in row.v] for row in kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def fit_centroids(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[int]]:
    """The integer centroids after ``rounds``; fewer than ``k`` where there are fewer usable vectors.

    The driver holds ``k`` vectors and their sums, whatever the input.
    """
    kept = fill_cores(usable(df, dims, scale, id_col, vector_col))
    rows = seeds(kept, k, scale, salt)
    for _ in range(rounds if rows else 0):
        sums, counts = _combined(kept, Centres(rows), scale, False)
        rows = [[s // n for s in own] if n else old for own, n, old in zip(sums.tolist(), counts.tolist(), rows, strict=True)]
    return rows


def cluster_vectors(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A component x becomes floor(scale * x).  Vectors that are null, of another length, or have a
    null or not finite component are left out.  Each round assigns every vector to the nearest
    centroid, the smallest number of equally near ones, and moves a centroid to the floored mean of
    its vectors; one without vectors stays.  Then all are assigned once more.  Repeated rows count
    each; a missing identifier is hashed as the empty one.  Fewer vectors than ``k`` give as many
    centroids; none give no rows, and further columns play no part.  Distances and sums are exact;
    one that a long cannot hold is null.
    """
    spark = df.sparkSession
    rows = fit_centroids(df, k, rounds, dims, scale, salt, id_col, vector_col)
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    kept, centres = fill_cores(usable(df, dims, scale, id_col, vector_col)), Centres(rows)
    sums, _ = _combined(kept, centres, scale, True)
    fits = lambda n: int(n) if n <= _LONG else None
    of_cluster, total = [fits(s) for s in sums[:, 0]], fits(sum(sums[:, 0]))
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dims, scale):
            cluster, distance = centres.nearest(x)
            number = pa.array(cluster, pa.int32())
            yield pa.record_batch(
                [part.column("vec_id"), number, pa.array(map(fits, distance.tolist()), pa.int64()), pa.array(of_cluster, pa.int64()).take(number), pa.repeat(pa.scalar(total, pa.int64()), len(x)), pa.array(digests).take(number)],
                schema=_SCHEMA,
            )

    return kept.mapInArrow(assign, SCHEMA)
