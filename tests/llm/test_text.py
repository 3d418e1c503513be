from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import documents, frame, odd_rows
from tomelight.llm import packing, pieces, pii, token_counts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def base(text):
    return [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1239.@+- ()%é\n", max_size=60))
def test_base_spans_are_the_patterns_own(text):
    assert base(text) == brute_spans(text)


@pytest.mark.parametrize("text", ["1" * 50_000, "1." * 30_000, "a" * 50_000 + "@", "+1" + " " * 50_000, "a@" * 20_000, "1 " * 30_000, "A1" * 20_000, "call 212-555-1234 or a@b.co " * 8_000])
def test_hostile_texts_stay_linear(text):
    assert isinstance(pii.find_spans(text), list)


def test_digest(spark):
    rows = documents() + odd_rows()
    got = pii.personal_data_digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = {k: n for n, k in enumerate(pii.KINDS)}
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")

    def wanted(text):
        spans = brute_spans(text)
        base_text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        every = sorted((s[:3] for s in pii.find_spans(text)), key=lambda s: (order[s[0]], s[1]))
        assert set(spans) <= set(every)
        return (*(sum(k == kind for k, _, _ in spans) for kind in pii.BASE_KINDS), hashlib.sha256(base_text.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in every))

    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=key) == sorted(((i, *wanted(t or "")) for i, t in rows), key=key)
    assert pii.personal_data_digest(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12), st.integers(0, 70), st.integers(1, 8))
def test_overlaps_as_all_pairs_say(spans, start, size):
    spans = [(a, a + n) for a, n in spans]
    assert pii._overlaps(*pii._united(spans), start, start + size) == any(a < start + size and start < b for a, b in spans)


def test_checksums_context_and_redaction(spark):
    text = "GB82 WEST 1234 5698 7654 32 is my iban; card 378282246310005 amex; call 212-555-1234; 212-555-9999 x"
    kinds = [s[0] for s in pii.find_spans(text)]
    assert kinds.count("iban") == 1 and kinds.count("short_card") == 1 and "local_phone" in kinds
    assert "GB82" not in pii.redact_text(text, pii.find_spans(text))
    assert not [s for s in pii.find_spans("GB83 WEST 1234 5698 7654 32") if s[0] == "iban"]
    assert pii.find_spans("number 212-555-9999 of the list") == []
    df = frame(spark, odd_rows())
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    row = out.filter("doc_id = 13").first()
    assert "[EMAIL]" in row["text"] and "[CARD]" in row["text"] and row["n_chars"] == len(row["text"])


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


ODD = ["", " ", "İstanbul ǅ café", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ", "日本語 テスト", "x\x1cy\x85z", "I'll don't they've'S", "ﬁ①½²", "​a\0", "a" * 500, "👍🏽", "ß ẞ ſ ŉ"]


def test_counts_equal_the_library(spark, counter, word_library):
    texts = [t for _, t in documents()] + ODD + [t or "" for _, t in odd_rows()]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in word_library.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.token_counts(frame(spark, odd_rows()), P.path("word_bpe_49k.json"), 100).collect()
    assert len(got) == len(odd_rows()) and all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert sorted(r["n_bytes"] for r in got) == sorted(len((t or "").encode()) for _, t in odd_rows())
    assert token_counts.token_counts(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehilnorstu", min_size=1, max_size=14))
def test_every_prefix_count_is_the_librarys(word):
    counter = token_counts.counter(P.path("word_bpe_49k.json"))
    library = _word_library()
    assert counter.prefix_counts(word) == [len(library.encode(word[:j], add_special_tokens=False).ids) for j in range(len(word) + 1)]


def _word_library(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Tokenizer.from_file(P.path("word_bpe_49k.json")))
    return kept[0]


@pytest.mark.parametrize("budget", [0, 1, 2, 7, 23])
def test_cut_is_the_longest_prefix(counter, word_library, budget):
    size = lambda t: len(word_library.encode(t, add_special_tokens=False).ids)
    texts = [documents()[k][1][:150] for k in range(4)] + ["I'll say they've 1234 things---don't!!", "naïve café ¿qué? élève", "  lead  and   trail  ", "", "supercalifragilistic"]
    for text in texts:
        assert counter.cut(text, budget) == max(j for j in range(len(text) + 1) if size(text[:j]) <= budget), text


@pytest.mark.parametrize("budget", [0, 1, 3, 10, 1000])
def test_cut_of_other_texts_ends_at_a_chunk(counter, word_library, budget):
    size = lambda t: len(word_library.encode(t, add_special_tokens=False).ids)
    for text in [*ODD, "日本語 тест\x85x\x1cy  ab <|endoftext|> İ ΑΣ done", " 日本 語 "]:
        if token_counts.PLAIN.search(text) or "<|" in text:
            ends = [m.end() for m in token_counts._CHUNK.finditer(text)]
            fits = [e for e in ends if size(text[:e]) <= budget]
            assert counter.cut(text, budget) == (len(text) if len(fits) == len(ends) else max(fits, default=0)), text


def test_within_chars(spark, word_library):
    rows = documents()[:60] + odd_rows()
    got = token_counts.token_counts(frame(spark, rows), P.path("word_bpe_49k.json"), 40).collect()
    table = token_counts.counter(P.path("word_bpe_49k.json"))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["within_chars"]) for r in got), key=key) == sorted(((i, table.count(t or ""), table.cut(t or "", 40)) for i, t in rows), key=key)


def test_packing(spark):
    rows = documents()[:80] + [(None, "x y"), (None, "another"), (900, None), (901, ""), (902, "word " * 6000), (903, "word " * 6000)]
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = packing.pack(frame(spark, rows), *args).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {(i, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    by_doc: dict[int | None, list] = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for (i, _), ids in want.items():  # every id of every document lies in one piece, with its bytes' checksum
        if i is None:
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted((r["length"], r["ids_crc32"]) for r in by_doc[None]) == sorted((len(x), zlib.crc32(x.tobytes())) for (i, _), x in want.items() if i is None)
    by_seq: dict[int, list] = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048
    assert sum(2048 - sum(max(p)) for p in by_seq.values()) < 0.05 * sum(map(len, want.values()))
    assert packing.pack(frame(spark, []), *args).count() == 0


def test_repeated_rows_are_packed_each(spark):
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = packing.pack(frame(spark, [(901, "again"), (901, "again"), (901, "other text")]), *args).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_balance_places_every_token_once(lengths):
    pieces_ = packing.balance(lengths)
    used: dict[int, list] = {}
    for length, parts in zip(lengths, pieces_, strict=True):
        at = 0
        for start, n, seq, offset in sorted(parts):
            assert start == at and n > 0
            at += n
            used.setdefault(seq, []).append((offset, n))
        assert at == length
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048
    assert len(used) <= -(-sum(lengths) // 2048) + (len(lengths) > 0)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(model):
    coder = pieces.coder(P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    letters = [*"abetr. ,1▁ \n", "é", "日", "\0"]
    texts = [t for _, t in documents()] + ODD + ["a  b", "  a", "\ta\n b ", "▁a", "x▁▁y   z", "....... ---- 1234567890", "    ", "a" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(800)]
    texts += ["".join(rng.choice(coder.usable) for _ in range(rng.randint(1, 8))).replace("▁", rng.choice([" ", "▁"])) for _ in range(800)]
    coder.learn(texts)
    for t in texts:
        ids = coder.encode(t)
        assert ids.tolist() == model.encode(t), repr(t)
        assert coder.decode(ids) == model.decode(ids.tolist()), repr(t)


def test_piece_frames(spark):
    rows = documents()[:50] + odd_rows()
    path = P.path("piece_bpe_32k.model")
    got = pieces.piece_digest(frame(spark, rows), path).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    ids = pieces.encode_pieces(frame(spark, rows), path)
    back = pieces.decode_pieces(ids, path).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in rows)
    assert pieces.piece_digest(frame(spark, []), path).count() == 0
