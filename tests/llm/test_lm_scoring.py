"""Language-model scores against a loop over counters of n-grams."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, frame, odd_rows
from tomelight.llm import lm_scoring
from tomelight.llm.lm_scoring import STRENGTHS, distinct, get_answers, get_counts, get_keys, put_answers, put_counts, put_keys, score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def loop(rows, strengths=STRENGTHS):
    lines = [(i, ["", *WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    order = len(strengths) + 1
    grams, contexts = Counter(), Counter()
    n_train = 0
    for i, w in lines:
        if not held(i):
            n_train += len(w) - 1
            for p in range(1, len(w)):
                for n in range(1, min(order, p + 1) + 1):
                    grams[tuple(w[p - n + 1 : p + 1])] += 1
                    contexts[tuple(w[p - n + 1 : p])] += 1
    distinct = sum(len(g) == 1 for g in grams)
    single = lambda w: (grams[(w,)] + 0.1) / (n_train + 0.1 * (distinct + 1))

    def prob(context, w):
        if not context:
            return single(w)
        m = strengths[len(context) - 1]
        return (grams[(*context, w)] + m * prob(context[1:], w)) / (contexts[context] + m)

    out = []
    for i, w in lines:
        base = sum(math.log10(single(x)) for x in w[1:])
        score = sum(math.log10(prob(tuple(w[max(0, p - order + 1) : p]), w[p])) for p in range(1, len(w)))
        out.append((i, held(i), len(w) - 1, sum(grams[(x,)] > 0 for x in w[1:]), n_train, base, score))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 4), round(r[6], 4))
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert np.allclose([r[k] for r in got], [r[k] for r in want], rtol=1e-11, atol=1e-9)


@pytest.mark.parametrize("block_bytes", [4e6, 2e4])
def test_whole_table(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    rows = documents()
    got = score_texts(frame(spark, rows))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), loop(rows))


@pytest.mark.parametrize("strengths", [(2.0,), (1.5, 0.5), (3.0, 1.0, 0.25)])
def test_few_words_in_many_blocks(spark, strengths, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 400)
    rng = random.Random(len(strengths))
    rows = [(rng.choice([k, k, 7, 11, 30, None]), " ".join(rng.choice(["a", "B", "b", "c", "É", "é", "dd" * 40]) for _ in range(rng.choice([0, 1, 2, 3, 30])))) for k in range(150)]
    same(score_texts(frame(spark, rows), strengths).collect(), loop(rows, strengths))


def test_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    same(score_texts(frame(spark, rows)).collect(), loop(rows))
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3e3)
    same(score_texts(frame(spark, rows * 2).withColumn("a.b", F.lit(1)).withColumn("n_train", F.lit("x"))).collect(), loop(rows * 2))


def test_without_training_texts(spark):
    out = [i for i in range(200) if held(i)]
    rows = [(i, "some words") for i in out] + [(None, None)]
    got = score_texts(frame(spark, rows)).collect()
    same(got, loop(rows))
    assert {r.train_tokens for r in got} == {0}
    assert score_texts(frame(spark, rows).limit(0)).collect() == []


def test_held_out_texts_are_likelier_than_by_single_tokens(spark):
    rows = [(k, t) for k, t in documents() if t]
    got = [r for r in score_texts(frame(spark, [*rows, *[(10_000 + k, t) for k, t in rows]])).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got) > sum(r.base_score for r in got)


def test_packed_keys_and_counts():
    rng = np.random.default_rng(1)
    counts = np.concatenate((rng.integers(0, 3, 500), [254, 255, 256, 1 << 40], rng.integers(0, 600, 500)))
    assert (get_counts(put_counts(counts), len(counts)) == counts).all()
    for top in (1, 200, 1 << 16, 1 << 41, 1 << 63):
        keys = np.unique(rng.integers(0, top, 1000).astype(np.uint64))
        assert (get_keys(put_keys(keys)) == keys).all()
    assert (get_keys(put_keys(np.array([0, (1 << 64) - 1], np.uint64))) == np.array([0, (1 << 64) - 1], np.uint64)).all()
    shared = rng.random(len(counts)) < 0.5
    got = get_answers(put_answers(shared, counts), len(counts))
    assert (got[0] == shared).all() and (got[1] == counts).all()


def test_distinct_keys_of_any_width():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        for top in (1, 2, 1 << 30, 1 << 63):
            keys = rng.integers(0, top, n).astype(np.uint64)
            keys = np.concatenate((keys, keys[: n // 2], keys[:3] + np.uint64(1)))
            for got, want in zip(distinct(keys), np.unique(keys, return_inverse=True), strict=True):
                assert (got == want).all()
