import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing as P

from .conftest import AWKWARD, docs_frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(PATH)


ALPHABET = ["a", "B", "'s", "re", "É", "H̱", "\n", "  ", "\t", " ", "\x1c", "\x85", "7", ".", ",", "...", "!?", "|", "<|endoftext|>", "★", "ß", "Σ", "İ", "漢字", "😀", "#*", "'d", "\x00", " a.", "ñ.", "x;"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join), max_size=3))
def test_encoder_is_the_tokenizer(encoder, plain, texts):
    want = [struct.pack(f"<{len(i)}I", *i) for i in (plain.encode(t, add_special_tokens=False).ids for t in texts)]
    assert encoder.encode(texts) == want


def test_cache_turnover(plain, monkeypatch):
    monkeypatch.setattr(P, "CACHE", 20)
    small = P.Encoder(PATH)
    random.seed(1)
    for _ in range(30):
        text = " ".join(f"w{random.randint(0, 99)}." for _ in range(40))
        assert small.encode([text])[0] == b"".join(struct.pack("<I", i) for i in plain.encode(text, add_special_tokens=False).ids)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_against_brute_force(spark, plain, awkward):
    rows = P.pieces(awkward, PATH, capacity=64, with_ids=True).collect()
    want = []
    for r in awkward.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 64)):
            data = struct.pack(f"<{len(ids[s : s + 64])}I", *ids[s : s + 64])
            want.append((r["doc_id"], k, s, len(data) // 4, zlib.crc32(data), data))
    assert sorted(map(str, [(*tuple(r)[:5], bytes(r["ids"])) for r in rows])) == sorted(map(str, want))
    packed = P.pack(P.pieces(awkward, PATH)).collect()
    assert len(packed) == P.pieces(awkward, PATH).count() >= len(AWKWARD)
    check_places(packed, P.CAPACITY)


@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
def test_best_fit_rules(lengths, most):
    bins, offsets, left = P.best_fit(lengths, 16, most)
    open_bins, made = {}, 0
    for size, b, o in zip(lengths, bins, offsets, strict=True):
        fits = {k: f for k, f in open_bins.items() if f >= size}
        if fits:
            assert b == min(k for k, f in fits.items() if f == min(fits.values())) and o == 16 - open_bins[b]
        else:
            assert (b, o) == (made, 0)
            made += 1
            if len(open_bins) == most:
                del open_bins[next(k for k, f in open_bins.items() if f == min(open_bins.values()))]
            open_bins[b] = 16
        open_bins[b] -= size
        if not open_bins[b]:
            del open_bins[b]
    assert left == sorted(open_bins)
    assert P.best_fit(lengths, 16, most, 3)[2] == sorted(k for k, f in open_bins.items() if f > 3)


def test_groups_lose_nothing(spark, nothing):
    random.seed(2)
    rows = [(k, 0, random.randint(1, 100)) for k in range(3000)]
    rows += rows[:5]
    packed = P.pack(spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint"), capacity=100, most_open=300, group_rows=300).collect()
    assert sorted((r["doc_id"], r["length"]) for r in packed) == sorted((a, c) for a, _, c in rows)
    assert check_places(packed, 100) <= 1.02 * sum(x[2] for x in rows) / 100 + 1
    assert P.pack(P.pieces(nothing, PATH)).count() == 0
    assert P.pieces(docs_frame(spark, [None]), PATH).first()["length"] == 1
