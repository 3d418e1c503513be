"""Centroid clustering against a loop in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF
from tomelight.llm.centroids import Centres, cluster_vectors, fit_centroids, largest_component

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster string, `a.b` int"


def frame(spark, rows, n_parts=5):
    return spark.createDataFrame([(i, e, 1, "x", "y", 2) for i, e in rows], SCHEMA).repartition(n_parts)


def loop(rows, k=40, rounds=5, dims=64, scale=256):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in e):
            kept.append((i, [math.floor(scale * x) for x in e], e))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    cs = [r[1] for r in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cs)]
    found = [(i, *near(v)) for i, v, _ in kept]
    per = {}
    for _, d, n in found:
        per[n] = per.get(n, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, n, fits(d), fits(per[n]), fits(sum(per.values())), sha[n]) for i, d, n in found]


def same(got, want):
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = list(zip(t["vec_id"], t["embedding"], strict=True))
    got = cluster_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(got.collect(), loop(rows))


@pytest.mark.parametrize("top", [1.0, 2.0**14, 2.0**20, 2.0**40, 2.0**110])
def test_components_of_any_size(spark, top):
    rng = random.Random(int(math.log2(top)))
    rows = [(k, [rng.choice([rng.uniform(-1, 1), rng.uniform(-top, top)]) if k % 3 else rng.uniform(-1, 1) for _ in range(4)]) for k in range(120)]
    rows += [(k, r[1]) for k, r in enumerate(rows[:20], 200)]
    same(cluster_vectors(frame(spark, rows), k=7, dims=4).collect(), loop(rows, k=7, dims=4))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float((k * j) % 5) - 2 for j in range(3)]) for k in range(12)]
    odd = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 2.0]), (54, [nan, 0.0, 0.0]), (55, [inf, 0.0, 0.0]), (56, [0.0, -inf, 0.0]), (57, [1.0, 2.0, 3.0, 4.0]), (58, [1.7e308, 0.0, 0.0])]
    rows = good + odd + [(3, good[3][1]), (3, [9.0, 9.0, -0.0]), (None, [1.0, 1.0, 1.0]), (None, None), (-4, [0.001, -0.001, 0.0])]
    same(cluster_vectors(frame(spark, rows), k=4, dims=3).collect(), loop(rows, k=4, dims=3))
    same(cluster_vectors(frame(spark, rows[:5]), k=40, dims=3).collect(), loop(rows[:5], k=40, dims=3))
    assert cluster_vectors(frame(spark, odd, 1), dims=3).collect() == []
    assert cluster_vectors(frame(spark, rows, 1).limit(0), dims=3).collect() == []
    assert fit_centroids(frame(spark, good), k=4, dims=3, rounds=2) == fit_centroids(frame(spark, good, 1), k=4, dims=3, rounds=2)


def test_bounds_are_exact():
    for dims in (1, 3, 64, 1000):
        for bits in (53, 63):
            m = largest_component(dims, bits)
            assert dims * (2 * m) ** 2 < 1 << bits <= dims * (2 * m + 6) ** 2
    m = largest_component(64, 53)
    for size in (m, m + 1, 30 * m, largest_component(64, 63), 1 << 40, 1 << 90):
        rows = [[size] * 64, [-size] * 64, [0] * 64, [1] * 64, [size - 1] * 64]
        x = np.array([[float(s)] * 64 for s in (0, 1, m, -m, size, -size)])
        cluster, distance = Centres(rows).nearest(x)
        for v, c, d in zip(x, cluster.tolist(), distance.tolist(), strict=True):
            assert (d, c) == min((sum((int(a) - b) ** 2 for a, b in zip(v, r, strict=True)), n) for n, r in enumerate(rows))
