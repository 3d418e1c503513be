"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster_vectors
from .common import table
from .exact_dedup import exact_groups
from .infilling import fill_in_middle_digest
from .lm_scoring import score_texts
from .packing import pack
from .pieces import piece_digest
from .pii import personal_data_digest
from .quality_model import fit_quality, score_quality
from .quality_rules import quality_rules
from .simhash import near_groups
from .suffix_dedup import repeated_bytes
from .substring import repeated_words
from .token_counts import token_counts


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` is on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))


_OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) t(p)
), shared AS (
  SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM shared, unnest(range(0, 35)) t(k)
), word AS (
  SELECT doc_id, i, ws[i] AS x FROM w, unnest(range(1, len(ws) + 1)) t(i)
), kept AS (
  SELECT word.doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id
)
SELECT w.doc_id,
       CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


_OP6_SQL = r"""
WITH b AS (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents
), byte AS (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM b
), s2 AS (
  SELECT *, x || lead(x, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM byte
), s4 AS (
  SELECT *, w2 || lead(w2, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w4 FROM s2
), s8 AS (
  SELECT *, w4 || lead(w4, 4) OVER (PARTITION BY doc_id ORDER BY i) AS w8 FROM s4
), s16 AS (
  SELECT doc_id, i, x, w2, w8 || lead(w8, 8) OVER (PARTITION BY doc_id ORDER BY i) AS w16 FROM s8
), s50 AS (
  SELECT doc_id, i, x,
         w16 || lead(w16, 16) OVER d || lead(w16, 32) OVER d || lead(w2, 48) OVER d AS w
  FROM s16 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), early AS (
  SELECT w, min(doc_id) AS first_id FROM s50 WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT s50.doc_id, i, x, coalesce(first_id < s50.doc_id, false) AS starts FROM s50 LEFT JOIN early USING (w)
), mark AS (
  SELECT doc_id, i, x, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit
), span AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS fresh FROM mark
), done AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (fresh) AS n_spans,
         string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM span GROUP BY doc_id
)
SELECT b.doc_id,
       CAST(len(l) AS BIGINT) AS n_bytes,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN done USING (doc_id)
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


_OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digest(table(spark, sf_dir, "documents"))


_OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(length(text), 0) AS n, sha256('1:' || doc_id) AS h FROM documents
), d AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS u, CAST('0x' || h[25:32] AS BIGINT) % 100 AS v FROM t
), f AS (
  SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


_OP12_ROUND = """
), a{r} AS MATERIALIZED (
  SELECT vec_id, c, sum((x.v - y.v) * (x.v - y.v)) AS d FROM part x JOIN c{r} y USING (i) GROUP BY vec_id, c
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
"""
_OP12_MOVE = """
), m{r} AS (
  SELECT c, i, sum(v) AS s, count(*) AS n FROM a{r} JOIN part USING (vec_id) GROUP BY c, i
), c{next} AS MATERIALIZED (
  SELECT c, i, CASE WHEN n IS NULL THEN v ELSE (s - (s % n + n) % n) // n END AS v FROM c{r} LEFT JOIN m{r} USING (c, i)
"""


def _op12_sql(rounds: int = 5) -> str:
    steps = "".join(_OP12_ROUND.format(r=r) + _OP12_MOVE.format(r=r, next=r + 1) for r in range(rounds)) + _OP12_ROUND.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), part AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(e, 1) AS i, CAST(floor(256 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS v FROM kept
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 40
), c0 AS MATERIALIZED (
  SELECT c, i, v FROM first JOIN part USING (vec_id)
{steps}
), told AS (
  SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN told USING (c)
"""


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_quality_model": op4_quality_model,
        "op5_quality_rules": op5_quality_rules,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_centroids": op12_centroids,
        "op13_lm_scoring": op13_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": _OP2_SQL,
        "op6_suffix_dedup": _OP6_SQL,
        "op10_exact_dedup": _OP10_SQL,
        "op11_fill_in_middle": _OP11_SQL,
        "op12_centroids": _op12_sql(),
    }
