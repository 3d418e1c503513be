"""Fill-in-middle transformation, in DuckDB inside Arrow batches.

Each batch of rows is registered as a table and one SQL statement cuts its texts, puts the parts in
their new order and hashes them; no row passes through Python by itself.  Texts are cut by code
points: a regular expression lists stretches of ``STRETCH`` code points, and only the two stretches
that hold a cut are listed again by single ones, so lists stay short for very long texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fill_cores
from .common import id_and_text

#: Of a hundred texts, how many are transformed; of a hundred of those, how many start with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
STRETCH = 64
#: Text bytes that one statement works on, besides its first text.
SLICE_BYTES = 4_000_000

CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _check_marks(marks: tuple[str, str, str]) -> None:
    """Marks that cannot be found across the border of a part and a mark, so the first one found is the true one."""
    if len(marks) != 3 or not all(marks) or len({m[0] for m in marks}) != 1 or any(m[0] in m[1:] for m in marks) or any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) != 3:
        raise ValueError("three different marks are needed that start with one and the same character, hold it nowhere else, and do not start each other")


_MACROS = f"""
CREATE MACRO points(s, i, j) AS coalesce(array_to_string(list_slice(regexp_extract_all(s, '(?s).'), i, j), ''), '');
CREATE MACRO part(c, a, b) AS CASE
  WHEN a // {STRETCH} = b // {STRETCH} THEN points(c[a // {STRETCH} + 1], a % {STRETCH} + 1, b % {STRETCH})
  ELSE points(c[a // {STRETCH} + 1], a % {STRETCH} + 1, {STRETCH}) || array_to_string(list_slice(c, a // {STRETCH} + 2, b // {STRETCH}), '') || points(c[b // {STRETCH} + 1], 1, b % {STRETCH})
END;
CREATE MACRO draw(h, k) AS CAST('0x' || substr(h, 8 * k - 7, 8) AS BIGINT);
"""


def _cut_sql(marks: tuple[str, str, str], rate: int, suffix_first: int, salt: str) -> str:
    p, s, m = map(_quoted, marks)
    return f"""
    WITH drawn AS (
      SELECT doc_id, text, length(text) AS n, sha256({_quoted(salt + ":")} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch
    ), formed AS (
      SELECT doc_id, text, n,
             least(draw(h, 1) % (n + 1), draw(h, 2) % (n + 1)) AS a,
             greatest(draw(h, 1) % (n + 1), draw(h, 2) % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR draw(h, 3) % 100 >= {int(rate)} THEN 'plain'
                  WHEN draw(h, 4) % 100 < {int(suffix_first)} THEN 'spm' ELSE 'psm' END AS form
      FROM drawn
    ), listed AS (
      SELECT *, CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).{{1,{STRETCH}}}') END AS c FROM formed
    ), parted AS (
      SELECT *, part(c, 0, a) AS prefix, part(c, a, b) AS middle, part(c, b, n) AS suffix FROM listed
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
           CASE form WHEN 'plain' THEN text
                     WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
                     ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
    FROM parted
    """


def _restored(marks: tuple[str, str, str]) -> str:
    """The text that ``output`` was made from, by ``form``: what lies between the first marks."""
    p, s, m = marks
    of = lambda first, second: f"string_split(substr(output, {len(first) + 1}), {_quoted(second)})"
    head, rest = lambda x: f"{x}[1]", lambda x, sep: f"array_to_string(({x})[2:], {_quoted(sep)})"
    third = lambda x: f"string_split({x}, {_quoted(m)})"
    psm, spm = of(p, s), of(s, p)
    after_psm, after_spm = third(rest(psm, s)), third(rest(spm, p))
    return f"""CASE form WHEN 'plain' THEN output
      WHEN 'psm' THEN {head(psm)} || {rest(after_psm, m)} || {head(after_psm)}
      WHEN 'spm' THEN {head(after_spm)} || {rest(after_spm, m)} || {head(spm)} END"""


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.Table]:
    """The rows of ``batch`` in order, by ``SLICE_BYTES`` of ``column``."""
    table = pa.Table.from_batches([batch])
    sizes = np.array(pc.binary_length(batch.column(column)).fill_null(0))
    slot = (np.cumsum(sizes) - 1) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(slot, prepend=-2)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        yield table.slice(a, b - a)


def _in_duckdb(sql: str, column: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that runs ``sql`` over the table ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": "1", "temp_directory": ""}) as con:
            con.execute(_MACROS)
            for batch in batches:
                for rows in _slices(batch, column) if batch.num_rows else ():
                    con.register("batch", rows)
                    yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                    con.unregister("batch")

    return run


def _map(df: DataFrame, sql: str, column: str, schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return fill_cores(df).mapInArrow(_in_duckdb(sql, column, fields), schema)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(df, id_col, text_col).select("doc_id", F.make_valid_utf8("text").alias("text"))


def fill_in_middle(
    df: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, salt: str = "1", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: doc_id, n, form, prefix_chars, middle_chars, output.

    The SHA-256 of ``salt:doc_id`` draws two cuts among the text's code points and its form: plain
    (the text as it is), psm (prefix, suffix, middle, each after its mark) or spm (suffix first).
    Texts that are empty or hold a mark stay plain.  A null text counts as empty; a missing
    identifier is drawn for as the empty one.  Repeated rows give equal rows, an empty input none;
    further columns play no part.  Bytes that are not UTF-8 become U+FFFD before anything is cut.
    """
    _check_marks(marks)
    return _map(_texts(df, id_col, text_col), _cut_sql(marks, rate, suffix_first, salt), "text", CUT + ", output string")


def restore(df: DataFrame, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """doc_id and the text that ``fill_in_middle`` made each ``output`` from; null for an unknown form or a null output."""
    _check_marks(marks)
    own = df.select(df[id_col].cast("long").alias("doc_id"), df[form_col].cast("string").alias("form"), F.make_valid_utf8(df[output_col].cast("string")).alias("output"))
    return _map(own, f"SELECT doc_id, {_restored(marks)} AS text FROM batch", "output", "doc_id long, text string")


def fill_in_middle_digest(
    df: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, salt: str = "1", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``fill_in_middle`` with digests in place of texts: of the output, and of what is restored from it in the same pass."""
    _check_marks(marks)
    sql = f"""SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({_restored(marks)}) AS restored_sha256
    FROM ({_cut_sql(marks, rate, suffix_first, salt)})"""
    return _map(_texts(df, id_col, text_col), sql, "text", CUT + ", output_sha256 string, restored_sha256 string")
