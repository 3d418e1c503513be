"""The corpus pipeline: documents pass through five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tomelight.llm.common import store, table
from tomelight.llm.exact_dedup import drop_exact_copies
from tomelight.llm.packing import pack
from tomelight.llm.pii import redact
from tomelight.llm.quality_model import fit_quality, keep_good
from tomelight.llm.simhash import drop_similar
from tomelight.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled documents, does not reject.

    A null text is judged as the empty one; repeated rows are judged each.
    """
    return keep_good(docs, fit_quality(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest identifier.

    A null text counts as empty, a missing identifier as the largest; of repeated rows one stays.
    """
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8), that of the smallest identifier.

    Texts without words are near copies of each other only; missing identifiers count as the largest.
    """
    ship(spark)
    return drop_similar(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; a null text becomes the empty one."""
    ship(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences; an empty text gives its end id, an empty table no rows."""
    ship(spark)
    path = public_tokenizers.path
    return pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private), ("packing", packing)]

#: The first stage's model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is written to the shared folder."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
