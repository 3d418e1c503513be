"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by normalised content, Spark's external sort places
equal texts next to each other, and each row is compared in full with its neighbour.  A splitter
holds a text's first characters and, to part texts that share them, a hash of the whole; it ends in
the identifier, so a group of equal texts of any size is dealt over as many partitions as it needs.
At most two runs a partition can go on in another one; only those are joined up afterwards, by
their whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, for_memory, id_and_text, parts_for, store, text_bytes

#: Leading characters of a text in its splitter key; splitters are small however long the texts.
SPLITTER_CHARS = 24
#: Text bytes that one sort partition should hold, for the usual memory.
PARTITION_BYTES = 8e6

_RUNS = "doc_id long, head_id long, run_size long, text_sha256 string, lead boolean, run long, run_text string"
_RUN_TYPE = pa.schema([("doc_id", pa.int64()), ("head_id", pa.int64()), ("run_size", pa.int64()), ("text_sha256", pa.string()), ("lead", pa.bool_()), ("run", pa.int64()), ("run_text", pa.string())])


def normalised(text_col: str = "text"):
    return F.regexp_replace(text_col, SPACE_CLASS + "+", " ")


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the head and size of their run in this partition.

    ``lead`` marks a run's first row.  The first and the last run may go on in a neighbouring
    partition: they have a number, ``run``, and their first rows have the text.  Of a run that is
    still growing, only the identifiers are held.
    """
    context = TaskContext.get()
    base = 2 * (context.partitionId() if context else 0)
    last_text: str | None = None
    last_sha = ""
    ids: list[pa.Array] = []
    first = True

    def rows(run: pa.Array, sha: str, number: int | None, text: str | None) -> pa.RecordBatch:
        n = len(run)
        lead = pa.array([True] + [False] * (n - 1))
        texts = pa.array([text if number is not None else None] + [None] * (n - 1), pa.string())
        return pa.RecordBatch.from_arrays(
            [run, pa.repeat(pa.scalar(run[0].as_py(), pa.int64()), n), pa.repeat(pa.scalar(n, pa.int64()), n), pa.repeat(pa.scalar(sha), n), lead, pa.repeat(pa.scalar(number, pa.int64()), n), texts],
            schema=_RUN_TYPE,
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, doc = batch.column("norm"), batch.column("doc_id")
        starts = [0] if last_text is None or text[0].as_py() != last_text else []
        if n > 1:
            new = pc.not_equal(text.slice(1), text.slice(0, n - 1))
            starts += (pc.indices_nonzero(new).to_numpy() + 1).tolist()
        done: list[pa.RecordBatch] = []
        head = starts[0] if starts else n
        if head:
            ids.append(doc.slice(0, head))
        for k, at in enumerate(starts):
            if ids:
                before = text[at - 1].as_py() if at and first else last_text
                done.append(rows(pa.concat_arrays(ids), last_sha, base if first else None, before))
                first = False
            end = starts[k + 1] if k + 1 < len(starts) else n
            ids = [doc.slice(at, end - at)]
            last_sha = hashlib.sha256(text[at].as_py().encode("utf-8", "surrogatepass")).hexdigest()
        last_text = text[n - 1].as_py()
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield rows(pa.concat_arrays(ids), last_sha, base if first else base + 1, last_text)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of the six space characters became one space; a
    null text counts as empty, an empty one equals other empty ones, and of equal texts one row
    stays: that of the smallest identifier, where a missing one counts as the largest.  Repeated
    identifiers each give a row; of equal texts that share the smallest one, one row is kept.  An
    empty input gives no rows.  Further columns of ``df`` play no part, whatever their names.
    """
    base = id_and_text(df, id_col, text_col)
    norm = base.select("doc_id", normalised().alias("norm"))
    keyed = norm.select("doc_id", "norm", F.substring("norm", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("norm").alias("h"))
    n = parts_for(text_bytes(df, text_col), for_memory(df, PARTITION_BYTES), 2)
    last = F.col("doc_id").asc_nulls_last()
    ordered = keyed.repartitionByRange(n, "head", "h", last).sortWithinPartitions("head", "h", "norm", last)
    runs = store(ordered.select("doc_id", "norm").mapInArrow(_mark_runs, _RUNS), "runs")
    # Two rows a partition at most.  Rows join them by run, and a run is no larger than a partition.
    border = runs.filter("run IS NOT NULL AND lead")
    whole = border.groupBy("run_text").agg(F.min("head_id").alias("_head"), F.sum("run_size").alias("_size"))
    whole = border.select("run_text", "run").join(whole, "run_text").select("run", "_head", "_size")
    apart = runs.filter("run IS NULL").select("doc_id", F.col("head_id").alias("keep_id"), F.col("run_size").alias("group_size"), "lead", "text_sha256")
    over = runs.filter("run IS NOT NULL").join(whole, "run").select("doc_id", F.col("_head").alias("keep_id"), F.col("_size").alias("group_size"), "lead", "text_sha256")
    # Rows that share text and identifier have one splitter key, hence one run, of which one row leads.
    kept = F.col("lead") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return apart.unionByName(over).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, of which one row of each group of equal texts stays.

    It is a row of the smallest identifier (a missing one counts as the largest); of rows that share
    text and identifier, the one whose columns hash least.  A null text counts as empty; an empty
    table gives an empty one.  Columns may have any names; they are numbered on the way.

    Both the numbering and the join are by identifier and text, so the rows are shuffled once for both.
    """

    def row_key(row_id, sha):
        return F.concat(F.coalesce(row_id.cast("long").cast("string"), F.lit("")), F.lit(":"), sha)

    kept = exact_groups(df, id_col, text_col).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    row_id, text = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    own = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    sha = F.sha2(normalised(F.coalesce(own[text].cast("string"), F.lit(""))).cast("binary"), 256)
    hashed = [own[c] for c, kind in own.dtypes if "map<" not in kind and kind != "variant"]
    ranked = own.select("*", row_key(own[row_id], sha).alias("key"), F.xxhash64(*hashed).alias("hash"))
    first = ranked.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("hash"))).filter("nth = 1")
    return first.join(kept, "key", "left_semi").select(*own.columns).toDF(*df.columns)
