"""Hash-chained logs: building, verifying, anchoring and reconciling them.

Lines are partitioned by day file, so a chain is checked with windows over one day each; only one
row a file meets in the window that stitches days together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .numbering import numbered


#: Lines of a day file that one task checks in a row.
SEGMENT_LINES = 100_000


def _readable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines before each file's first unreadable one, and where that is."""
    bad = lines.filter("NOT parses").groupBy("file").agg(F.min("line_no").alias("bad_line"))
    good = lines.join(bad, "file", "left").filter("bad_line IS NULL OR line_no < bad_line").drop("bad_line")
    return good, bad


def _following(lines: DataFrame, segment: int = SEGMENT_LINES) -> DataFrame:
    """``lines`` with ``want``, the hash of the raw line before each in its file; null for a file's first.

    A file is cut into segments of ``segment`` line numbers: lines look back within their segment, and
    a segment's first line at the last line of the segment before, of which there is one row each.
    """
    cut = lines.withColumn("_segment", F.floor(F.col("line_no") / segment))
    lasts = cut.groupBy("file", "_segment").agg(F.sha2(F.max_by("raw", "line_no"), 256).alias("_last"))
    before = lasts.select("file", "_segment", F.lag("_last").over(W.partitionBy("file").orderBy("_segment")).alias("_before"))
    own = F.lag("raw").over(W.partitionBy("file", "_segment").orderBy("line_no"))
    return cut.join(before, ["file", "_segment"]).withColumn("want", F.coalesce(F.sha2(own, 256), "_before")).drop("_segment", "_before")


def verify_chain(lines: DataFrame, segment: int = SEGMENT_LINES) -> DataFrame:
    """file, events, breaks, bad_line, boundary for ``lines`` (file, line_no, raw, prev_hash, parses).

    A line must carry the hash of the raw line before it; a mismatch counts and the walk goes on.
    An unreadable line ends its file.  A file's first line must carry the hash of the last readable
    line of the file before (linked), nothing (legacy), or the chain is broken there; in the first
    file it must carry nothing.
    """
    good, bad = _readable(lines)
    per_file = _following(good, segment).groupBy("file").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if((F.col("line_no") > 1) & ~F.col("prev_hash").eqNullSafe(F.col("want"))).alias("breaks"),
        F.min_by("prev_hash", "line_no").alias("first_prev"),
        F.min("line_no").alias("first_no"),
        F.max_by("raw", "line_no").alias("last_raw"),
    )
    days = W.partitionBy(F.lit(1)).orderBy("file")  # one row a day file
    stitched = per_file.withColumn("before", F.sha2(F.lag("last_raw").over(days), 256)).withColumn("nth", F.row_number().over(days))
    boundary = (
        F.when(F.col("nth") == 1, F.when(F.col("first_prev").isNull(), "first").otherwise("broken"))
        .when(F.col("first_prev").isNull(), "legacy")
        .when(F.col("first_prev") == F.col("before"), "linked")
        .otherwise("broken")
    )
    out = stitched.select("file", "events", "breaks", boundary.alias("boundary"))
    return lines.select("file").distinct().join(out, "file", "left").join(bad, "file", "left").select("file", F.coalesce("events", F.lit(0).cast("bigint")).alias("events"), F.coalesce("breaks", F.lit(0).cast("bigint")).alias("breaks"), "bad_line", F.coalesce("boundary", F.lit("empty")).alias("boundary"))


def chain_smoke(lines: DataFrame, indexed: DataFrame, segment: int = SEGMENT_LINES) -> DataFrame:
    """file, problem, line_no: the first problem within each file, or fewer lines than the index knows."""
    step = _following(lines, segment)
    problem = F.when(~F.col("parses"), "BAD_JSON").when((F.col("line_no") > 1) & ~F.col("prev_hash").eqNullSafe(F.col("want")), "HASH_MISMATCH")
    first = step.withColumn("problem", problem).filter("problem IS NOT NULL").groupBy("file").agg(F.min_by("problem", "line_no").alias("problem"), F.min("line_no").alias("line_no"))
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    short = indexed.join(counts, "file", "left").filter(F.coalesce("n", F.lit(0)) < F.col("indexed")).select("file", F.lit("TRUNCATED").alias("problem"), F.lit(None).cast("bigint").alias("line_no"))
    return first.unionByName(short.join(first.select("file"), "file", "left_anti"))


def _positions(lines: DataFrame) -> DataFrame:
    """``lines`` with their global position: a running count of files before plus the place in the file."""
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("start", F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("file")) - F.col("n")).select("file", "start")  # one row a day file
    return numbered(lines, "file", ["line_no"], "place").join(before, "file").withColumn("position", F.col("start") + F.col("place"))


def anchor_body(total, head, previous, at: str = "2024-02-01T00:00:00.000Z", workspace: str = "w"):
    """The canonical JSON of an anchor; its keys have a fixed order."""
    prev = F.when(previous.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), previous, F.lit('"')))
    return F.concat(F.lit(f'{{"schemaVersion":1,"anchoredAt":"{at}","workspaceId":"{workspace}","totalEvents":'), total.cast("string"), F.lit(',"chainHead":"'), head, F.lit('","prevAnchorHash":'), prev, F.lit("}"))


def chain_head(lines: DataFrame) -> DataFrame:
    """One row: total events and the hash of the last line."""
    return lines.agg(F.count(F.lit(1)).alias("total"), F.sha2(F.max_by("raw", F.struct("file", "line_no")), 256).alias("head"))


def append_anchor(lines: DataFrame, last: DataFrame) -> DataFrame:
    """The next anchor after ``last`` (n, total, head, anchor_hash; one row or none); none if nothing changed."""
    now = chain_head(lines)
    prior = last.select(F.col("n").alias("_n"), F.col("total").alias("_t"), F.col("head").alias("_h"), F.col("anchor_hash").alias("_a"))
    j = now.crossJoin(F.broadcast(prior)) if not last.isEmpty() else now.select("*", F.lit(0).alias("_n"), F.lit(None).cast("bigint").alias("_t"), F.lit(None).cast("string").alias("_h"), F.lit(None).cast("string").alias("_a"))
    new = j.filter(~(F.col("_t").eqNullSafe(F.col("total")) & F.col("_h").eqNullSafe(F.col("head"))))
    return new.select((F.col("_n") + 1).alias("n"), "total", "head", F.col("_a").alias("prev_hash"), F.sha2(anchor_body(F.col("total"), F.col("head"), F.col("_a")), 256).alias("anchor_hash"))


def verify_anchors(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """n, verdict: self-hash, link to the anchor before, truncation, rewriting; the first that fails.

    Anchors are few: one a batch of work.
    """
    own = W.partitionBy(F.lit(1)).orderBy("n")
    linked = anchors.withColumn("before", F.lag("anchor_hash").over(own))
    total = lines.agg(F.count(F.lit(1)).alias("events"))
    heads = _positions(lines).join(anchors.select(F.col("total").alias("position")).distinct(), "position").select("position", F.sha2("raw", 256).alias("found"))
    j = linked.join(heads, linked["total"] == heads["position"], "left").crossJoin(F.broadcast(total))
    verdict = (
        F.when(F.col("anchor_hash") != F.sha2(anchor_body(F.col("total"), F.col("head"), F.col("prev_hash")), 256), "SELF_HASH")
        .when(~F.col("prev_hash").eqNullSafe(F.col("before")), "LINK")
        .when(F.col("events") < F.col("total"), "TRUNCATED")
        .when(F.col("found") != F.col("head"), "REWRITTEN")
        .otherwise("ok")
    )
    return j.select("n", verdict.alias("verdict"))


def build_chain(events: DataFrame) -> DataFrame:
    """file, line_no, line for ``events`` (file, line_no, payload): each line carries the hash of the line before.

    A chain is sequential by nature; each file's is built in one task from its sorted lines, which
    pass by in batches, so that a file of any length takes the memory of a batch.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, at = None, None
        for batch in batches:
            out = []
            for file, payload in zip(batch.column("file").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                link = "null" if file != at else f'"{previous}"'
                out.append(f'{{"payload":{payload},"prev_hash":{link}}}')
                previous, at = hashlib.sha256(out[-1].encode()).hexdigest(), file
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("line_no"), pa.array(out, pa.string())], names=["file", "line_no", "line"])

    rows = events.select("file", F.col("line_no").cast("bigint").alias("line_no"), "payload")
    return rows.repartition("file").sortWithinPartitions("file", "line_no").mapInArrow(fold, "file string, line_no long, line string")


def reconcile_provenance(traced: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Per key: counts on both sides, a code where the sidecar has fewer, and how many it has more."""
    keys = ["source_id", "output_path", "operation"]
    t = traced.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trace"))
    s = sidecar.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sidecar"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    j = t.join(s, keys, "full_outer").select(*keys, zero("n_trace").alias("n_trace"), zero("n_sidecar").alias("n_sidecar"))
    return j.select("*", F.when(F.col("n_sidecar") < F.col("n_trace"), "PROVENANCE_SIDECAR_MISSING").alias("code"), F.greatest(F.col("n_sidecar") - F.col("n_trace"), F.lit(0).cast("bigint")).alias("unreceipted"))


def reconcile_index(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """file, indexed, on_disk, status of the trace index against the files."""
    j = indexed.join(on_disk, "file", "full_outer")
    status = (
        F.when(F.col("on_disk").isNull(), "MISSING_FILE").when(F.col("indexed").isNull(), "UNINDEXED_FILE").when(F.col("on_disk") < F.col("indexed"), "TRUNCATED").when(F.col("on_disk") > F.col("indexed"), "UNINDEXED_EVENTS").otherwise("ok")
    )
    return j.select("file", "indexed", "on_disk", status.alias("status"))


def reconcile_spool(files: DataFrame, manifests: DataFrame, traced: DataFrame) -> DataFrame:
    """file, codes: what is wrong between spool files, their manifests and traced digests."""
    f = files.select("file", "sha", "lines", F.lit(True).alias("_f"))
    m = manifests.select("file", F.col("sha").alias("m_sha"), "emitted", "malformed", F.lit(True).alias("_m"))
    j = f.join(m, "file", "full_outer").join(traced.select("file", F.col("sha").alias("t_sha")), "file", "left").filter("_f OR _m")
    both = F.col("_f").isNotNull() & F.col("_m").isNotNull() & ~F.coalesce("malformed", F.lit(False))
    codes = (
        ("SPOOL_MANIFEST_MISSING", F.col("_m").isNull()),
        ("SPOOL_MANIFEST_MALFORMED", F.coalesce("malformed", F.lit(False))),
        ("SPOOL_FILE_MISSING", F.col("_f").isNull() & ~F.coalesce("malformed", F.lit(False))),
        ("SPOOL_HASH_MISMATCH", both & (F.col("sha") != F.col("m_sha"))),
        ("SPOOL_COUNT_MISMATCH", both & (F.col("lines") != F.col("emitted"))),
        ("SPOOL_TRACE_MISMATCH", both & (F.col("t_sha") != F.col("m_sha"))),
    )
    return j.select("file", F.array_compact(F.array(*(F.when(c, n) for n, c in codes))).alias("codes"))
