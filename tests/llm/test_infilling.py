"""Fill-in-middle against a loop over texts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, frame, odd_rows
from tomelight.llm import infilling
from tomelight.llm.infilling import fill_in_middle, fill_in_middle_digest, restore


def loop(doc, text, rate=90, first=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or d[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    form = "spm" if d[3] % 100 < first else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    return doc, n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return repr(tuple(row))


ROWS = [
    *odd_rows(), *[(100 + k, "é日<x" * k + "<S" + "\0\n" * (k % 3)) for k in range(300)], *[(500 + k, "x" * (62 + k)) for k in range(70)],
    (1001, "has <M> in it"), (1002, "<P>"), (1003, "<P"), (1004, "🤦🏼‍♂️" * 50), (1005, "a\r\n b" * 100), (-7, "negative id " * 9), (1006, "'quoted' \\ $1 " * 20),
]


def test_output_and_restored_text(spark):
    df = frame(spark, ROWS)
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [loop(i, t) for i, t in ROWS]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(key, out.collect())) == sorted(map(key, want))
    assert sorted(map(key, restore(out).collect())) == sorted(key((i, t or "")) for i, t in ROWS)


def test_digests_over_the_whole_table(spark, tmp_path):
    rows = documents()
    got = fill_in_middle_digest(frame(spark, rows)).collect()
    want = [(*(w := loop(i, t))[:5], sha(w[5]), sha(t)) for i, t in rows]
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("size", [1, 50, 4000])
def test_slices_are_in_order_and_bounded(size, monkeypatch):
    monkeypatch.setattr(infilling, "SLICE_BYTES", size)
    batches = pa.table({"doc_id": [i for i, _ in ROWS], "text": [t or "" for _, t in ROWS]}).to_batches()
    parts = [t for b in batches for t in infilling._slices(b, "text")]
    assert [x for t in parts for x in t.column("doc_id").to_pylist()] == [i for i, _ in ROWS]
    assert all(t.num_rows and sum(len((x or "").encode()) for x in t.column("text").to_pylist()[1:]) < size for t in parts)


def test_other_rates_and_marks(spark):
    df = frame(spark, ROWS)
    assert {r.form for r in fill_in_middle(df, rate=0).collect()} == {"plain"}
    forms = fill_in_middle(df, rate=100, suffix_first=100).filter("n > 0 and form <> 'plain'").select("form").distinct().collect()
    assert [r.form for r in forms] == ["spm"]
    marks = ("¦pre>", "¦suf>", "¦mid's>")
    out = fill_in_middle(df, marks=marks)
    assert sorted(map(key, restore(out, marks).collect())) == sorted(key((i, t or "")) for i, t in ROWS)
    for bad in (("<P>", "<S>", "<S>"), ("<P<", "<S>", "<M>"), ("<", "<S>", "<M>"), ("<P>", "S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(df, marks=bad)


def test_empty_table_bad_bytes_and_odd_names(spark):
    df = frame(spark, ROWS[:3])
    assert fill_in_middle_digest(df.limit(0)).collect() == []
    odd = df.withColumn("a.b", F.lit(1)).withColumn("form", F.lit("x")).withColumn("output", F.lit(None).cast("int")).withColumn("n", F.lit("z"))
    assert sorted(map(key, fill_in_middle(odd).collect())) == sorted(key(loop(i, t)) for i, t in ROWS[:3])
    bad = spark.sql("SELECT 5L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert restore(fill_in_middle(bad)).first().text == "a�b"
    assert restore(spark.createDataFrame([(1, "odd", "x"), (2, "psm", None)], "doc_id long, form string, output string")).orderBy("doc_id").collect() == [(1, None), (2, None)]
