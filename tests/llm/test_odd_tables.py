"""Stages on tables with odd columns, and blocks of rows that hold no text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.conftest import SF
from tests.llm.helpers import frame, odd_rows
from tomelight.llm import packing
from tomelight.llm.common import ROW_BYTES, text_bytes
from tomelight.llm.components import connected_components
from tomelight.llm.exact_dedup import exact_groups
from tomelight.llm.lm_scoring import score_texts
from tomelight.llm.packing import pack
from tomelight.llm.suffix_dedup import repeated_bytes
from tomelight.llm.substring import repeated_words


def odd(spark):
    df = frame(spark, odd_rows()).drop("n_chars")
    df = df.withColumn("a.b", F.lit(1)).withColumn("_exact_key", F.lit("k")).withColumn("_exact_nth", F.lit(7)).withColumn("n_chars", F.lit("many")).withColumn("c0", F.lit(0.5)).withColumn("key", F.array(F.lit(1)))
    return df.withColumn("hash", F.lit("x")).withColumn("`", F.lit(True)).withColumn("_near_id", F.lit(3)).withColumn("nth", F.create_map(F.lit("a"), F.lit(1)))


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_take_columns_of_any_name(spark, name):
    stage = dict(C.STAGES)[name]
    plain, clashing = frame(spark, odd_rows()).select("doc_id", "text", "lang", "source", "n_chars"), odd(spark)
    got, want = stage(spark, clashing, SF), stage(spark, plain, SF)
    if name == "packing":
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
        return
    assert got.columns == clashing.columns
    assert [k for k in got.dtypes] == [k for k in clashing.dtypes]
    rows = [r.asDict() for r in got.collect()]
    assert sorted(repr((r["doc_id"], r["text"])) for r in rows) == sorted(repr((r["doc_id"], r["text"])) for r in want.collect())
    assert {(r["a.b"], r["_exact_key"], r["n_chars"], r["c0"], r["nth"]["a"]) for r in rows} == {(1, "k", "many", 0.5, 1)}


def test_rows_without_text_are_dealt_over_blocks(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text"))
    assert text_bytes(df) == ROW_BYTES * n
    got = pack(df, *_encoder())
    per_block = [r.n for r in got.groupBy(F.shiftright("sequence_id", 32)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_block) == n and len(per_block) >= ROW_BYTES * n / packing.BLOCK_BYTES / 2 and max(per_block) < 1.2 * n / len(per_block)
    groups = exact_groups(df)
    assert groups.rdd.getNumPartitions() > 1
    assert groups.groupBy("keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect() == [(0, n, n, 1)]


def _encoder():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.mark.parametrize("operator", [repeated_words, repeated_bytes, score_texts])
def test_block_operators_on_rows_without_text(spark, operator):
    df = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text"))
    assert operator(df).count() == 100_000


def test_long_chain_settles(spark):
    n = 3000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(edges).agg(F.count(F.lit(1)).alias("n"), F.max("root").alias("root")).first() == (n + 1, 0)
