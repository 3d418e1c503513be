"""Duplicate lines or repetition alone can make an outlier, and the estimate keeps the smallest determinant."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tomelight.llm import quality_rules as R


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def lined(words: list[str]) -> str:
    return "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(11)
    good = [(k, lined(prose(rng, rng.randint(80, 400)))) for k in range(200)]
    lines = "\n".join([*[" ".join(prose(rng, 2))] * 60, lined(prose(rng, 150))])  # two words a line: no triple repeats inside
    half = prose(rng, 100)
    repeats = lined([*half, *(w for _ in range(34) for w in ("so", "it", "goes", *prose(rng, 2)))])
    return {r["doc_id"]: r for r in R.quality_rules(frame(spark, [*good, (900, lines), (901, repeats)])).collect()}


def test_repetition_alone_rejects(judged):
    row = judged[901]
    assert not row["base_failed"] and row["n_dup_lines"] == 0 and row["n_repeat_words"] > 40 and not row["kept"]


def test_duplicate_lines_reject(judged):
    assert judged[900]["n_dup_lines"] == 59 and not judged[900]["kept"]


def test_ordinary_texts_stay(judged):
    assert sum(judged[k]["kept"] for k in range(200)) >= 190


def test_each_statistic_can_reach_the_cutoff():
    lines, repeats = (R.LEAST_SPREAD[i] ** 2 + R.FLOORS[i] ** 2 for i in (3, 4))
    assert 1 / lines > R.CUTOFF and 0.5 / repeats > R.CUTOFF


def test_variance_is_floored_and_not_raised(spark):
    n = len(R.FEATURES)
    moments = spark.range(1).select(
        F.lit("g").alias("g"), F.lit(0).alias("start"), *(F.lit(0.0).alias(f"m_{i}") for i in range(n)), *(F.lit(4.0 if i == j == 0 else 0.0).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1))
    )
    row = R._factored(R._raised(moments)).first()
    want = [4.0, *(x**2 for x in R.LEAST_SPREAD[1:])]
    assert all(abs(row[f"l_{i}_{i}"] ** 2 - want[i] - R.FLOORS[i] ** 2) < 1e-12 for i in range(n))
