from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.helpers import documents, frame, odd_rows
from tomelight.llm import quality_model as M
from tomelight.llm import quality_rules as R


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    triples = list(zip(w, w[1:], w[2:], strict=False))
    many = Counter(triples)
    covered = {k + j for k, t in enumerate(triples) if many[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("rows", [documents() + odd_rows(), [(1, "a b a b a b\n\nx\nx\n")], []])
def test_base_rules(spark, rows):
    got = R.quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(brute_counts(t) for _, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(1)
    good = [(k, " ".join(f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(80, 200))))) for k in range(300)]
    bad = [(1000 + k, " ".join(f"$#{rng.integers(10**6)}%&" for _ in range(100))) for k in range(40)]
    got = {r["doc_id"]: r["kept"] for r in R.quality_rules(frame(spark, good + bad)).collect()}
    assert sum(not got[k] for k, _ in good) == 0
    assert sum(got[k] for k, _ in bad) == 0


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([("g", k % R.SALTS, *map(float, r)) for k, r in enumerate(x)], "g string, salt int, " + ", ".join(f"{f} double" for f in R.FEATURES))
    params = R._factored(R._moments(df))
    got = np.sort([r["d2"] for r in R._with_distance(df, params).select("d2").collect()])
    cov = np.cov(x.T, bias=True) + np.diag(np.square(R.FLOORS))
    d = x - x.mean(axis=0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))


def test_main_path_is_native(spark, monkeypatch):
    plans = []
    store = R.store

    def seen(df, label="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(R, "store", seen)
    out = R.quality_rules(frame(spark, odd_rows() + documents()[:80]))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5
    for plan in plans:
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan.replace("Scan ExistingRDD", "").replace("LocalTableScan", ""))


def statistics(rows):
    out = []
    for _, text, _, _ in rows:
        n, chars, symbols, dup, repeats = brute_counts(text)
        lines = sum(1 for x in text.split("\n") if x.strip())
        out.append([np.log1p(n), np.log((chars + 1) / n), np.sqrt(symbols / (chars + 1)), np.sqrt(dup / max(lines, 1)), np.sqrt(repeats / n)])
    return np.array(out)


def nth(values, share):
    """Of whole numbers, the least that ``share`` of them don't exceed."""
    v = np.sort(values)
    return v[int(np.ceil(share * len(v) - 1e-9)) - 1]


def grid(x):
    return np.floor(np.asarray(x) * R.GRID)


def squared(x, m, c):
    d = x - m
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)


def brute_estimate(x, salt):
    """Centre and covariance (floors added) of the start of least determinant."""
    floors, least = np.diag(np.square(R.FLOORS)), np.square(R.LEAST_SPREAD)

    def raised(m, c):
        c = c.copy()
        np.fill_diagonal(c, np.maximum(np.diag(c), least))
        return m, c + floors

    middle = np.array([nth(grid(x[:, k]), 0.5) for k in range(5)]) / R.GRID
    spread = np.array([nth(grid(abs(x[:, k] - middle[k])), 0.5) for k in range(5)]) / R.GRID
    starts = [raised(middle, np.diag((1.4826 * spread) ** 2))]
    for part in range(1, R.PART_STARTS + 1):
        y = x[salt % R.START_PARTS + 1 == part]
        if len(y):
            starts.append(raised(y.mean(axis=0), np.cov(y.T, bias=True).reshape(5, 5) if len(y) > 1 else np.zeros((5, 5))))
    dets = [np.linalg.slogdet(c)[1] for _, c in starts]
    return starts, dets


def brute_concentrate(groups):
    """Every start of every group steps until its determinant falls no more."""
    floors, least = np.diag(np.square(R.FLOORS)), np.square(R.LEAST_SPREAD)
    best = {}
    for g, (x, salt) in groups.items():
        starts, dets = brute_estimate(x, salt)
        for k, (m, c) in enumerate(starts):
            was = np.inf
            while True:
                far = grid(np.log1p(squared(x, m, c)))
                core = x[far <= nth(far, R.CORE)]
                cov = np.cov(core.T, bias=True).reshape(5, 5) if len(core) > 1 else np.zeros((5, 5))
                np.fill_diagonal(cov, np.maximum(np.diag(cov), least))
                m, c = core.mean(axis=0), cov + floors
                det = np.linalg.slogdet(c)[1]
                if not det < was - R.SETTLED:
                    break
                was = det
            starts[k], dets[k] = (m, c), det
        best[g] = starts[int(np.argmin(dets))]
    return best


def test_kept_against_brute_force(spark):
    rng = np.random.default_rng(7)
    text = lambda n, size: " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(size - 2, size + 3)))) for _ in range(n))
    rows = []
    for lang, source, n, size in (("en", "a", 160, 5), ("en", "b", 25, 6), ("en", "c", 2, 7), ("de", "a", 90, 8), ("de", "z", 1, 8)):
        for _ in range(n):
            body = text(int(rng.integers(60, 300)), size)
            odd = rng.random()
            if odd < 0.05:
                body = "\n".join(["same line here now"] * 30 + [body])
            elif odd < 0.1:
                body = body.replace("a", "#$").replace("b", "%&")
            elif odd < 0.15:
                body = text(70, 14)
            rows.append((len(rows), body, lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    salt = {r[0]: r[1] for r in df.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {R.SALTS})").collect()}
    x, salts = statistics(rows), np.array([salt[r[0]] for r in rows])
    names = [(r[2], r[3]) for r in rows]
    base = np.array([n < 50 or 100 * rep > 50 * n for n, _, _, _, rep in (brute_counts(r[1]) for r in rows)])
    own = {g: np.array([k for k, name in enumerate(names) if name == g and not base[k]]) for g in dict.fromkeys(names)}
    best = brute_concentrate({g: (x[k], salts[k]) for g, k in own.items()})
    want = {}
    scales, mixed = {}, {}
    for lang in ("en", "de"):
        gs = [g for g in own if g[0] == lang]
        n = np.array([len(own[g]) for g in gs], float)
        m_all = sum(w * best[g][0] for w, g in zip(n, gs, strict=True)) / n.sum()
        s_all = sum(w * (best[g][1] + np.outer(best[g][0], best[g][0])) for w, g in zip(n, gs, strict=True)) / n.sum()
        c_all = s_all - np.outer(m_all, m_all)
        for k, g in zip(n, gs, strict=True):
            w = k / (k + R.PRIOR_ROWS)
            gap = best[g][0] - m_all
            mixed[g] = (w * best[g][0] + (1 - w) * m_all, w * best[g][1] + (1 - w) * c_all + w * (1 - w) * np.outer(gap, gap))
            scales[g] = min(1.0, R.CHI2_MEDIAN / np.expm1((nth(grid(np.log1p(squared(x[own[g]], *mixed[g]))), 0.5) + 1) / R.GRID))
        whole = sum(k * scales[g] for k, g in zip(n, gs, strict=True)) / n.sum()
        for k, g in zip(n, gs, strict=True):
            scale = (k * scales[g] + R.PRIOR_ROWS * whole) / (k + R.PRIOR_ROWS)
            want |= dict(zip(own[g].tolist(), (squared(x[own[g]], *mixed[g]) * scale).tolist(), strict=True))
    got = {r["doc_id"]: r for r in R.quality_rules(df.repartition(7)).collect()}
    assert all(not got[k]["kept"] and got[k]["base_failed"] for k in np.flatnonzero(base).tolist())
    assert all(abs(got[k]["d2"] - d2) < 1e-6 * max(1, d2) for k, d2 in want.items())
    assert all(got[k]["kept"] == (d2 <= R.CUTOFF) for k, d2 in want.items())
    assert 3 < sum(not got[k]["kept"] for k in want) < 60


def test_model_learns_tables_and_interactions():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (3000, len(M.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 0.8)).astype(float)
    model = M.fit(x[:2000], y[:2000])
    assert (1, 0) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert M.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert M.fit(x[:50], np.ones(50)).score(x[:5]).min() > 0.5


def test_score_is_sum_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (500, len(M.FEATURES)))
    model = M.fit(x, (x[:, 3] > 0.5).astype(float))
    row = x[0]
    total = model.intercept + sum(t[int((e <= v).sum())] for e, t, v in zip(model.edges, model.tables, row, strict=True))
    total += sum(t[int((ea <= row[a]).sum()), int((eb <= row[b]).sum())] for (a, b), (ea, eb), t in zip(model.pairs, model.pair_edges, model.pair_tables, strict=True))
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    big = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = M.fit_quality(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in M.score_quality(docs, model).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert np.mean([b for a, b in held if a == 1]) > 0.99


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (8, 1), (None, 1)], "doc_id long, quality int")
    df = frame(spark, odd_rows())
    model = M.fit_quality(df, labels)
    scored = M.score_quality(df, model).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert M.keep_good(df, model).columns == df.columns
    none = frame(spark, [])
    assert M.score_quality(none, M.fit_quality(none, labels.filter("false"))).count() == 0
