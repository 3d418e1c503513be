"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn.  Each step fits a shallow tree of one feature to the
gradient and adds it, shrunk, to that feature's lookup table over bins; then pairs of features,
picked by how much of the remaining gradient their quadrants explain, get tables of two dimensions
the same way.  A score is the sum of looked-up entries through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fill_cores
from .common import id_and_text, map_all_columns

#: Labelled rows that a fit takes at most, those of the smallest hash of their identifier.
MAX_LABELLED = 20_000
FOLDS = 5
THRESHOLD = 0.3

MAX_BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, LEAVES, LEAST_HESSIAN, PENALTY = 0.1, 4, 2.0, 1.0

FEATURES = (
    "log_words", "word_length", "symbols", "exclamations", "upper", "digits", "punctuation", "beyond_ascii", "spaces",
    "distinct_words", "top_word", "repeated_next", "repeated_triples", "duplicate_lines", "line_words", "unclosed",
)


def _classes() -> np.ndarray:
    """For each byte, membership in the counted classes."""
    table = np.zeros((256, 8))
    for k, chars in enumerate((b"#*$%&|<>", b"!", bytes(range(65, 91)), b"0123456789", b".,;:?()'\"-")):
        table[list(chars), k] = 1
    table[128:, 5] = 1
    table[list(b" \t\n\r\x0b\x0c"), 6] = 1
    table[list(range(97, 123)), 7] = 1
    return table


_TABLE = _classes()


def features(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE
    symbols, bangs, upper, digits, punctuation, high, space, lower = counts.tolist()
    words = raw.split()
    n = len(words)
    size = max(len(raw) - space, 1.0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = max(n, 1)
    seen = Counter(words)
    triples = max(n - 2, 0)
    return [
        float(np.log1p(n)),
        size / w,
        symbols / size,
        bangs / size,
        upper / max(upper + lower, 1.0),
        digits / size,
        punctuation / size,
        high / size,
        space / w,
        len(seen) / w,
        max(seen.values(), default=0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        1.0 - len(set(zip(words, words[1:], words[2:]))) / triples if triples else 0.0,
        1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(n / max(len(lines), 1))),
        0.0 if raw.rstrip()[-1:] in (b".", b"!", b"?", b"") else 1.0,
    ]


@dataclass
class QualityModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0) for _ in FEATURES])
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1) for _ in FEATURES])
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), (ea, eb), table in zip(self.pairs, self.pair_edges, self.pair_tables, strict=True):
            total += table[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _bin_edges(values: np.ndarray, most: int) -> np.ndarray:
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, most + 1)[1:-1], method="midpoint"))
    return cuts[(cuts > values.min()) & (cuts <= values.max())]


def _leaf(g: float, h: float) -> float:
    return -g / (h + PENALTY)


def _gain(g: float, h: float) -> float:
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most ``LEAVES`` leaves, grown by best gain."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    while len(parts) < LEAVES:
        best, where = 1e-9, None
        for k, (a, b) in enumerate(parts):
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            gl, hl, gr, hr = cg[cut] - cg[a], ch[cut] - ch[a], cg[b] - cg[cut], ch[b] - ch[cut]
            gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            gain[(hl < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = -1
            if gain.max() > best:
                best, where = gain.max(), (k, int(cut[gain.argmax()]))
        if where is None:
            break
        k, cut = where
        parts[k : k + 1] = [(parts[k][0], cut), (cut, parts[k][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each of the two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = []
            for c in (cg, ch):
                a, left, top, whole = c[i, j], c[-1, j], c[i, -1], c[-1, -1]
                parts.append((a, top - a, left - a, whole - top - left + a))
            if min(parts[1]) < LEAST_HESSIAN / 2:
                continue
            gain = sum(map(_gain, *parts)) - _gain(cg[-1, -1], ch[-1, -1])
            if gain > best:
                best, v = gain, list(map(_leaf, *parts))
                values = np.zeros_like(g)
                values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = v
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """A model of P(y = 1); without rows it scores one half, with one class it stays near it."""
    model = QualityModel()
    if not len(x):
        return model
    model.intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model.edges = [_bin_edges(x[:, k], MAX_BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    total = np.full(len(x), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = gradient()
            n = len(model.tables[k])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[k] += step
            total += step[b]
    coarse = [_bin_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cbins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradient()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = cbins[a] * shape[1] + cbins[b]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = {(a, b): _quadrants(*grids(a, b))[0] for a in range(len(bins)) for b in range(a)}
    model.pairs = [p for p, gain in sorted(gains.items(), key=lambda i: (-i[1], i[0]))[:PAIRS] if gain > 0]
    model.pair_edges = [(coarse[a], coarse[b]) for a, b in model.pairs]
    model.pair_tables = [np.zeros((len(ea) + 1, len(eb) + 1)) for ea, eb in model.pair_edges]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step = RATE * _quadrants(*grids(a, b))[1]
            model.pair_tables[k] += step
            total += step[cbins[a], cbins[b]]
    return model


_VECTOR = "doc_id long, x array<double>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit_quality(df: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model from at most ``most`` labelled documents outside the held-out fold.

    Null and other labels than 0 and 1 are left out; of contradicting labels the lower one counts.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    base = id_and_text(df, id_col, text_col)
    # ``drawn`` has at most ``most`` rows of two numbers.
    labelled = base.join(F.broadcast(drawn), base["doc_id"] == drawn["_id"], "left_semi")
    rows = labelled.mapInArrow(_vectors, _VECTOR).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "x", "_y").collect()
    rows.sort(key=lambda r: r[0])
    x = np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[2] for r in rows], float))


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted.

    A null text scores as the empty one, which has a score like any other.  Repeated rows each give
    a row, an empty input none; further columns play no part.
    """
    scored = fill_cores(id_and_text(df, id_col, text_col)).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that the model does not reject.

    Rows are judged where they lie, without a shuffle; a null text is judged as the empty one.
    Repeated rows are judged each; an empty table gives an empty one.  Columns may have any names.
    """

    def run(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        x = np.array([features(t.as_py() or "") for t in batch.column(at)], float).reshape(-1, len(FEATURES))
        return batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return map_all_columns(df, text_col, run)
