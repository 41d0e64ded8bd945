import os
import random
import re

import numpy as np
import pytest
import xxhash

from weftline.llm import _shared
from weftline.llm import simhash as S

from .conftest import docs_frame


def brute_fingerprint(text, width):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    n = max(1, len(words) - width + 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most):
    """fps: (doc_id, unsigned fingerprint). Smallest doc_id that each can reach."""
    n, up = len(fps), list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= most:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), fps[i][0]), fps[i][0])
    return [least[root(i)] for i in range(n)]


def texts(shortest=3):
    random.seed(6)
    vocabulary = [f"W{k}" for k in range(300 if shortest < 10 else 3000)]
    base = [random.choices(vocabulary, k=random.randint(shortest, 400)) for _ in range(25)]
    out = []
    for _ in range(120):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        out.append(" ".join(words))
    return [*out, None, "", " \n "]


@pytest.mark.parametrize(("width", "most"), [(4, 4), (5, 5), (2, 7), (4, 0)])
def test_against_brute_force(spark, width, most, monkeypatch):
    some = texts()
    rows = sorted(S.near_duplicates(docs_frame(spark, some), width, most).collect(), key=lambda r: r["doc_id"])
    fps = [(k, brute_fingerprint(t, width)) for k, t in enumerate(some)]
    assert [r["fp"] % (1 << 64) for r in rows] == [f for _, f in fps]
    assert [r["component_id"] for r in rows] == brute_components(fps, most)
    if most <= 5:
        monkeypatch.setattr(S, "WIDE_FROM", 0)
        wide = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs_frame(spark, some), width, most).collect()}
        assert wide == {r["doc_id"]: r["component_id"] for r in rows}


@pytest.mark.parametrize(("most", "wide"), [*((k, False) for k in range(8)), *((k, True) for k in range(6))])
def test_every_close_pair_meets(most, wide):
    """The covering property itself: whatever bits differ, both come to the home anchor of one of them."""
    rng = np.random.default_rng(most)
    for _ in range(100):
        x = int(rng.integers(1 << 63)) * 2 + int(rng.integers(2))
        y = x
        for b in rng.choice(64, most, replace=False):
            y ^= 1 << int(b)
        pair = np.array([x, y], np.uint64).view(np.int64)
        anchor, fp, home = S.anchor_rows(pair, most, wide)
        assert set(anchor[(fp == pair[0]) & (home == 1)]) & set(anchor[fp == pair[1]])
    with pytest.raises(ValueError):
        S.parts_of(8)


def test_anchors_are_code_words_within_radius():
    for bits in (15, 16, 21, 22, 31, 33):
        length = S.code_length(bits)
        value = np.random.default_rng(bits).integers(1 << bits, size=20_000)
        found = S.syndromes(value, length)
        assert set(found.tolist()) == set(range(length + 1))
        for s, flips in enumerate(S.moves(bits)):
            moved = value[found == s][:50][:, None] ^ flips[None, :]
            assert (S.syndromes(moved.ravel(), length) == 0).all()
            assert np.bitwise_count(flips).max() <= 2 and np.bitwise_count(flips[0]) <= 1 and len(set(flips.tolist())) == len(flips)


def test_large_groups_in_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    base = int(rng.integers(1 << 62))
    fps = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(900)], np.uint64).view(np.int64))
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 5000)
    stars = S.Stars()
    S.link_groups(*S.anchor_rows(fps), stars)
    assert len({stars.root(int(x)) for x in fps}) == 1 and len(stars.links) == len(fps) - 1
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 4 for a, b in stars.links)


def shingle_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """By all pairs: texts without words are one group, others are linked at a similarity of 0.8 or more."""
    sets = [shingle_sets(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if not sets[i] and not sets[j] or common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_one_of_each_against_brute_force(spark):
    some = texts(120)
    kept = {r["doc_id"] for r in S.one_of_each(docs_frame(spark, some)).collect()}
    want = set(brute_groups(some))
    assert want <= kept and len(some) - len(kept) >= 0.9 * (len(some) - len(want)) > 0.5 * len(some)


def test_one_of_each(spark, awkward, nothing, monkeypatch):
    out = S.one_of_each(awkward)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == awkward.columns and len(kept) == len(set(kept))
    every = [r["text"] for r in awkward.collect()]
    assert len(kept) == len(set(brute_groups(every)))
    monkeypatch.setattr(S, "WIDE_FROM", 0)  # wide parts find the same
    assert sorted(map(str, kept)) == sorted(str((r["doc_id"], r["text"])) for r in S.one_of_each(awkward).collect())
    assert S.one_of_each(nothing).count() == 0 and S.near_duplicates(nothing).count() == 0
    again = docs_frame(spark, ["the very same text"])
    assert S.one_of_each(again.unionByName(again)).count() == 1


def test_one_of_each_loses_no_link(spark, monkeypatch):
    """Texts of few distinct pairs of words whose new words leave their shingles 0.8 alike but not their fingerprints; with fingerprints that find nothing, too."""
    rng = random.Random(21)
    some = []
    for k in range(60):
        words = [rng.choice([f"a{k}", f"b{k}", f"c{k}"]) for _ in range(90)]
        some += [" ".join(words), " ".join(words + [f"n{k}x{i}" for i in range(len(shingle_sets(" ".join(words))) // 5)])]
    some += texts(60)
    want = set(brute_groups(some))
    assert {r["doc_id"] for r in S.one_of_each(docs_frame(spark, some)).collect()} == want
    monkeypatch.setattr(S, "MOST_OF_128", -1)
    assert {r["doc_id"] for r in S.one_of_each(docs_frame(spark, some)).collect()} == want
    monkeypatch.setattr(S, "MOST_AT_SHINGLE", 1)  # all of it by the rarest shingles
    assert {r["doc_id"] for r in S.one_of_each(docs_frame(spark, some)).collect()} == want


def test_only_the_result_is_left_on_disk(spark):
    folder = _shared.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert S.one_of_each(docs_frame(spark, ["a few words here", "a few words here", "others"])).count() == 2
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["first"]
