from __future__ import annotations

import random

import pyarrow.parquet as pq

from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents() -> list[tuple[int, str]]:
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "one"), (6, "a  b\tc"), (7, "a b c"), (8, long), (9, long), (10, "x" * 20_000), (11, "x" * 20_000), (None, "one"),
        (12, "a " * 4000), (13, "Mail me@x.example or 4111 1111 1111 1111 now " * 3), (14, "日本語 текст mixed " * 40), (15, "日本語 текст mixed " * 40),
    ]


def frame(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA)
    for name in ("block", "bucket", "fp", "head", "h", "norm", "g", "keep_id", "_kept_id", "count", "spans"):
        df = df.withColumn(name, df["source"])
    return df


def mutated(seed: int, n: int = 120, alphabets=("a", "ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzé "), joiner: str = "") -> list[tuple[int, str]]:
    """Random texts that copy stretches from each other, with repeated identifiers."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        w = [rng.choice(rng.choice(alphabets)) * rng.choice([1, 1, 2]) for _ in range(rng.choice([0, 3, 34, 35, 36, 60, 200, 500]))]
        if rows and rng.random() < 0.6:
            src = rows[rng.randrange(len(rows))][1]
            src = src.split() if joiner else list(src)
            if len(src) > 55:
                a = rng.randrange(len(src) - 51)
                w[len(w) // 2 : len(w) // 2] = src[a : a + rng.choice([34, 35, 49, 50, 51, 180])]
        rows.append((rng.choice([k, k, 7]), joiner.join(w)))
    return rows
