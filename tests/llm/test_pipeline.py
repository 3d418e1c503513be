from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.conftest import SF
from tests.llm.helpers import SCHEMA, frame, odd_rows
from tests.llm.test_near_whole import brute as near_components
from tomelight.llm import pii
from tomelight.llm import quality_model as M


def test_stages_keep_columns_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = C.STAGES[-1][1](spark, docs, SF)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    assert [s for s, _ in C.STAGES] == ["quality", "exact", "near", "private", "packing"]


def test_run_equals_its_stages(spark):
    once = sorted(map(tuple, C.run(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == once


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def slow_stages(rows, model):
    """The rows after each stage but the last, by loops over (doc_id, text)."""
    good = [(i, t) for i, t in rows if model.score(np.array([M.features(t or "")], float))[0] >= M.THRESHOLD]
    yield "quality", good
    best: dict = {}
    for i, t in good:
        k = plain(t)
        if k not in best or (i is not None and (best[k][0] is None or i < best[k][0])):
            best[k] = (i, t)
    exact = list(best.values())
    yield "exact", exact
    root = near_components([(i, t or "") for i, t in exact])
    first: dict = {}
    for k, (i, _) in enumerate(exact):
        r = root.get(k, k)
        if r not in first or (i is not None and (exact[first[r]][0] is None or i < exact[first[r]][0])):
            first[r] = k
    near = [exact[k] for k in sorted(first.values())]
    yield "near", near
    yield "private", [(i, pii.redact_text(t or "", pii.find_spans(t or ""))) for i, t in near]


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for (name, want), (_, stage) in zip(slow_stages(rows, model), C.STAGES, strict=False):
        docs = stage(spark, docs, SF)
        assert pairs(docs) == sorted(want, key=repr), name
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in want}
    by_doc: dict = {}
    for r in C.packing(spark, docs, SF).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[i])
            at += r["length"]
        assert at == len(ids[i])


GOOD, OTHER = ("good words " + " ".join(f"g{k}" for k in range(90)), "other text " + " ".join(f"o{k}" for k in range(90)))
ODD = [*odd_rows(), (None, None), (20, GOOD), (20, OTHER), (21, GOOD + " end"), (None, GOOD + "  end")]


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES[1:]])
def test_stages_on_odd_rows(spark, name):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names; then an empty table."""
    stage = dict(C.STAGES)[name]
    df = frame(spark, ODD)
    out = stage(spark, df, SF)
    if name == "packing":
        assert {r["doc_id"] for r in out.collect()} == {i for i, _ in ODD}
    else:
        assert out.columns == df.columns
        got = pairs(out)
        if name == "exact":
            kept = {plain(t): (i, t) for i, t in got}
            assert len(kept) == len(got) == len({plain(t) for _, t in ODD})
            assert kept["one"][0] == 4 and kept[GOOD][0] == 20 and kept[GOOD + " end"][0] == 21 and kept[""][0] == 1
        if name == "near":
            ids = [i for i, t in got if t and t.startswith("good words")]
            assert ids == [20] and [i for i, t in got if t and t.startswith("other text")] == [20]
            assert [i for i, t in got if not (t or "").strip()] == [1]
        if name == "private":
            assert len(got) == len(ODD) and all(t is not None for _, t in got)
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_quality_stage_on_odd_rows(spark):
    df = frame(spark, ODD)
    out = C.quality(spark, df, SF)
    assert out.columns == df.columns and set(map(repr, pairs(out))) <= {repr(r) for r in ODD}
    assert C.quality(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0
