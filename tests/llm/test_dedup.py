from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import documents, frame, mutated, odd_rows
from tomelight.llm import blocks, exact_dedup, rindex, simhash, substring, suffix_dedup
from tomelight.llm.blocks import Rolling
from tomelight.llm.components import connected_components


def _key(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=_key)


def brute_exact(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out, taken = [], set()
    for i, t in norm:
        kept = i == least[t] and t not in taken
        taken |= {t} if kept else set()
        out.append((i, least[t], len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=_key)


@pytest.mark.parametrize("rows", [documents(), odd_rows(), [(k, random.Random(k // 3).choice(["same", "other", "x"]) * (k % 2)) for k in range(500)], []])
def test_exact_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PARTITION_BYTES", 400)  # runs go over many partitions
    assert rows_of(exact_dedup.exact_groups(frame(spark, rows))) == brute_exact(rows)


def test_exact_hot_group_spans_partitions(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "parts_for", lambda *a: 16)
    rows = [(k, "hot text") for k in range(3000)] + [(k, f"t{k}") for k in range(3000, 3500)]
    got = exact_dedup.exact_groups(frame(spark, rows))
    assert got.filter("group_size = 3000 AND keep_id = 0").count() == 3000
    assert exact_dedup.drop_exact_copies(frame(spark, rows)).count() == 501


@pytest.mark.parametrize("rows", [odd_rows(), [(None, "same"), (None, "same"), (3, "x  y"), (3, "x\ty"), (3, "other"), (9, "same "), (9, "same ")], []])
def test_one_row_of_equal_texts_stays(spark, rows):
    df = frame(spark, rows)
    got = exact_dedup.drop_exact_copies(df)
    assert got.columns == df.columns
    norm = [(r["doc_id"], re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")) for r in got.collect()]
    assert sorted(norm, key=_key) == sorted(((i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for (i, t) in _first_rows(rows)), key=_key)


def _first_rows(rows):
    best = {}
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        if key not in best or (i is not None and (best[key][0] is None or i < best[key][0])):
            best[key] = (i, t)
    return best.values()


def brute_words(rows, size=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(b" ".join(w[p : p + size]) for _, w in words for p in range(len(w) - size + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if seen[b" ".join(w[p : p + size])] > 1:
                gone[p : p + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=_key)


@pytest.mark.parametrize("rows", [documents(), odd_rows(), mutated(1, joiner=" "), mutated(2, joiner=" "), [(1, "short")], []])
def test_repeated_words(spark, rows, monkeypatch):
    monkeypatch.setattr(substring, "parts_for", lambda *a: 5)
    assert rows_of(substring.repeated_words(frame(spark, rows))) == brute_words(rows)


def test_equal_windows_have_equal_marks():
    texts = [t.encode() for _, t in mutated(4, 200, joiner=" ")]
    words = substring.Words(texts)
    mark, _ = words.marks()
    seen = defaultdict(set)
    for d, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - 34):
            seen[b" ".join(w[p : p + 35])].add(int(mark[words.starts[d] + p]))
    assert seen and all(len(s) == 1 for s in seen.values())


def test_runs_and_pairs_shrink_and_name_consistently():
    words = substring.Words([b" ".join(b"w%d" % (k % 50) for k in range(2000))])
    first = words.symbols(1)[0]
    later, _, lo, hi = words.symbols(4)
    assert len(later) < len(first) < 2000
    same = words.roll[0](lo, hi)
    by_range = defaultdict(set)
    for name, key in zip(later.tolist(), same.tolist(), strict=True):
        by_range[key].add(name)
    assert all(len(v) == 1 for v in by_range.values())


def test_signatures_are_equal_just_for_equal_ranges():
    rng = random.Random(8)
    part = [f"p{k % 23}" for k in range(120)]
    words = substring.Words([" ".join([rng.choice("abc") for _ in range(rng.randint(0, 40))] + part[: rng.randint(60, 120)]).encode() for _ in range(60)])
    own = [w for d in range(60) for w in range(words.starts[d], words.starts[d] + words.counts[d])]
    start = np.array([s for s in own for n in (1, 3, 20, 35) if not words.barrier[s : s + n].any() and s + n < len(words.word)])
    end = start + np.array([n for s in own for n in (1, 3, 20, 35) if not words.barrier[s : s + n].any() and s + n < len(words.word)])
    spelled = defaultdict(set)
    for s, e, name in zip(start.tolist(), end.tolist(), words.signature(start, end).tolist(), strict=True):
        spelled[name].add(words.word[s:e].tobytes())
    assert all(len(v) == 1 for v in spelled.values())
    assert len(spelled) == len({words.word[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)})


def test_verification_uses_the_symbols_names():
    text = b" ".join(b"w%d" % (k * k % 97) for k in range(200))
    words = substring.Words([text, text])
    at = np.flatnonzero(words.valid)
    names = words.names(at)
    assert (names[: len(at) // 2] == names[len(at) // 2 :]).all()
    words.parsed[0][len(words.parsed[0]) // 4] ^= np.uint64(1)  # another name for one symbol of the first copy
    words.parsed = (*words.parsed[:4], Rolling(words.parsed[0], substring._SYMBOL_BASE))
    names = words.names(at)
    assert not (names[: len(at) // 2, 0] == names[len(at) // 2 :, 0]).all()


@pytest.mark.parametrize("power", [10, 11])
def test_words_that_collide_in_polynomial_hashes(spark, power):
    swap = bytes.maketrans(b"ab", b"ba")
    word = b"a"
    for _ in range(power):
        word += word.translate(swap)
    common = b" ".join(b"c%d" % k for k in range(34))
    rows = [(1, (common + b" " + word).decode()), (2, (common + b" " + word.translate(swap)).decode())]
    assert rows_of(substring.repeated_words(frame(spark, rows))) == brute_words(rows)


def test_rolling_hash_depends_on_content_only():
    a = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    h = Rolling(a, 0x9E3779B97F4A7C15)(np.array([0, 3]), np.array([3, 6]))
    assert h[0] == h[1]


def brute_bytes(rows, size=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    big = 1 << 62
    first: dict[bytes, int] = {}
    for i, b in raw:
        for p in range(len(b) - size + 1):
            first[b[p : p + size]] = min(first.get(b[p : p + size], big + 1), big if i is None else i)
    out = []
    for i, b in raw:
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < (big if i is None else i):
                edge[p] += 1
                edge[p + size] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=_key)


@pytest.mark.parametrize("rows", [documents()[:120], odd_rows(), mutated(5), mutated(6), [(1, "short")], []])
def test_repeated_bytes(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "parts_for", lambda *a: 5)
    assert rows_of(suffix_dedup.repeated_bytes(frame(spark, rows))) == brute_bytes(rows)


def test_windows_of_hot_marks(spark, monkeypatch):
    rng = random.Random(12)
    phrase = "a phrase that is in all of these documents, "  # shorter than a window
    rows = [(k, phrase.join("".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 70))) for _ in range(4))) for k in range(150)]
    rows += [(k + 200, rows[k][1][rng.randint(0, 60) :]) for k in range(0, 150, 5)]
    monkeypatch.setattr(suffix_dedup, "parts_for", lambda *a: 5)
    answer = suffix_dedup.answer_marks

    def sooner_hot(asked):
        from tomelight.llm import blocks  # in a worker of its own

        blocks.HOT_PLACES, blocks.HOT_CONTEXTS = 8, 2
        return answer(asked)

    monkeypatch.setattr(suffix_dedup, "answer_marks", sooner_hot)
    assert rows_of(suffix_dedup.repeated_bytes(frame(spark, rows))) == brute_bytes(rows)


def test_only_marks_of_many_surroundings_are_hot(monkeypatch):
    monkeypatch.setattr(blocks, "HOT_PLACES", 100)
    monkeypatch.setattr(blocks, "HOT_CONTEXTS", 10)
    keys, bit = np.array([1, 2, 3], np.uint64), lambda k: np.uint64(1 << k)
    asked = pa.concat_tables([blocks.ask_marks(b, keys, np.zeros(3, bool), np.array([50, 50, 1]), np.array([bit(b), bit(7), bit(b)]), 1) for b in range(20)])
    for bits in blocks.answer_marks(asked).column("bits").to_pylist():
        told = {0: np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)}
        assert [x.tolist() for x in blocks.read_marks(keys, told, 1)] == [[True, True, True], [True, False, False]]


@pytest.mark.parametrize("n_blocks", [1, 2, 5, 300])
def test_marks_are_hot_in_any_number_of_blocks(n_blocks):
    """One mark of 100,000 differing places, one of as many places with equal surroundings, one just below the bound."""
    keys = np.array([1, 2, 3], np.uint64)
    whole, own = np.uint64((1 << 64) - 1), 100_000 // n_blocks
    places = np.array([own, own, 20_000 // n_blocks])
    asked = pa.concat_tables([blocks.ask_marks(b, keys, np.ones(3, bool), places, np.array([whole, np.uint64(8), whole]), 1) for b in range(n_blocks)])
    for bits in blocks.answer_marks(asked).column("bits").to_pylist():
        told = {0: np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)}
        assert [x.tolist() for x in blocks.read_marks(keys, told, 1)] == [[True] * 3, [True, False, False]]


def test_marks_count_their_stretches_and_surroundings():
    phrase = b"the same twenty bytes and more of them"
    texts = [bytes([65 + k % 50]) * 30 + phrase + bytes([70 + k % 50]) * 30 for k in range(400)]
    key, several, places, around = suffix_dedup.Stretches(texts, 50).marks()
    assert places.max() >= 300 and several[places.argmax()] and int(np.bitwise_count(around[places.argmax()])) > blocks.HOT_CONTEXTS / 2
    again = blocks._get_marks(blocks._put_marks(several, places, around), len(key))
    assert all((x == y).all() for x, y in zip(again, (several, places, around), strict=True))


def test_hot_marks_are_split_into_windows():
    texts = [b"x" * 20 + b"some text that goes on for a good while, longer than a window of fifty"]
    own = suffix_dedup.Stretches(texts, 50)
    windows = int(own.count.sum())
    key = own.marks()[0]
    own.narrow({0: np.ones(2 * len(key), bool)}, 1)
    assert len(own.doc) == windows and set(own.count.tolist()) == {1} and len(set(own.mark.tolist())) == windows


@pytest.mark.parametrize("length", [7, 14, 20, 50])
def test_run_index_matching_statistics(length):
    rng = random.Random(length)
    for _ in range(15):
        letters = rng.choice([b"a", b"ab", b"abcd"])
        own = [bytes(rng.choice(letters) for _ in range(rng.randint(length, length + 60))) for _ in range(rng.randint(1, 25))]
        own = list(dict.fromkeys(own + [s[3:] + s[:5] for s in own]))
        own = [s for s in own if len(s) >= length]
        least = np.array([rng.randint(0, 9) for _ in own])
        index = rindex.RunIndex(own, least, length)
        patterns = own + [bytes(rng.choice(letters) for _ in range(rng.randint(0, length + 30))) for _ in range(5)]
        want: dict[bytes, int] = {}
        for s, o in zip(own, least.tolist(), strict=True):
            for p in range(len(s) - length + 1):
                want[s[p : p + length]] = min(want.get(s[p : p + length], 99), o)
        top = np.iinfo(np.int64).max
        assert index.stream(patterns).tolist() == [want.get(s[p : p + length], top) for s in patterns for p in range(len(s) - length + 1)]
        assert index.runs <= index.n


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict[int, int | None] = {}
    for i, f in prints:
        r = find(f)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, f"{f:016x}", least[find(f)]) for i, f in prints), key=_key)


def near_copies():
    rng = random.Random(9)
    base = [rng.choice(["red", "green", "blue", "black", "white", "grey"]) + str(rng.randrange(50)) for _ in range(400)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        rows.append((1000 - k, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [documents(), odd_rows(), near_copies(), []])
def test_near_groups(spark, rows):
    assert rows_of(simhash.near_groups(frame(spark, rows))) == brute_components(rows)


def test_hot_signatures_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SIGNATURES", 20)
    rows = near_copies()
    assert rows_of(simhash.near_groups(frame(spark, rows))) == brute_components(rows)
    prints = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    plan = simhash.allocate(prints, len(prints))
    hot = simhash.hot_keys(prints, len(prints), plan)
    key, fps, _ = simhash.split_hot(*simhash.signatures(prints, plan), hot, 4)
    assert len(hot) and not np.isin(key, hot).any() and set(fps.tolist()) == set(prints.tolist())


@pytest.mark.parametrize("n", [3, 1000, 10**7, 10**9])
def test_allocation_covers_the_distance(n):
    drawn = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    plan = simhash.allocate(drawn, n)
    assert sum(t + 1 for _, t in plan) == simhash.DISTANCE + 1
    bits = [b for part, _ in plan for b in part]
    assert len(bits) == len(set(bits))


def test_search_connects_what_is_linked(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_GROUP", 200)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**64, 20, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    near = np.unique(np.concatenate((centre, centre[rng.integers(0, 20, 2000)] ^ flip() ^ flip())))
    edges: list[tuple[int, int]] = []
    simhash._search(near, 4, edges)
    assert all((a ^ int(b)).bit_count() <= 4 for a, b in edges)
    node, root = simhash._stars([], edges)
    assert len(node) == len(near) - 20


def test_connected_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}


def test_drop_near_copies_keeps_columns(spark):
    df = frame(spark, near_copies())
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns and 1 <= out.count() < 150
    assert out.agg(F.min("doc_id")).first()[0] == df.agg(F.min("doc_id")).first()[0]


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def edited_copies(seed):
    """Texts of their own and copies of some with few or many words changed."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(k, fresh(rng.randrange(120, 400))) for k in range(120)]
    for k in range(120, 200):
        w = list(rows[rng.randrange(60)][1])
        for _ in range(rng.choice([1, 1, 2, 3, len(w) // 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, w))
    return [(i, " ".join(w)) for i, w in rows]


def test_similar_groups_against_brute_force(spark):
    rows = edited_copies(1)
    sets = [shingles(t) for _, t in rows]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, rows)).collect()}
    near = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(rows)) for b in range(a)]
    sure = [(a, b) for a, b, j in near if j >= 0.85]
    assert len(sure) > 50 and sum(got.get(a, a) == got.get(b, -b - 1) for a, b in sure) >= 0.9 * len(sure)
    best: dict[int, float] = {}
    for a, b, j in near:
        best[a], best[b] = max(best.get(a, 0), j), max(best.get(b, 0), j)
    assert all(best[i] > 0.65 for i in got)


def test_similar_edge_cases_and_dense_group(spark):
    df = frame(spark, odd_rows())
    out = simhash.drop_similar(df)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == df.columns and {1, 4, 6, 8, 10} <= kept and not {2, 3, 5, 7, 9, 11, None} & kept  # the row without identifier is a copy of 4
    assert simhash.similar_groups(frame(spark, [])).count() == 0
    crowd = [(k, " ".join([f"word{j}" for j in range(300)] + [f"own{k}"])) for k in range(400)]
    assert [r["doc_id"] for r in simhash.drop_similar(frame(spark, crowd)).collect()] == [0]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.8, 0.95, 1.0):
        n = int(1000 * 2 * share / (1 + share))
        other = np.concatenate((base[:n], rng.integers(0, 2**64, 1000 - n, dtype=np.uint64)))
        assert abs(simhash.alike(simhash.sketch(base), simhash.sketch(other)) - share) < 0.1
    assert simhash.alike(simhash.sketch(base[:0]), simhash.sketch(base[:0])) == 1.0
