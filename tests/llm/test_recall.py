"""Pairs at the least similarity: what the candidate search must not lose."""

import random

import pytest

from weftline.llm import line_dedup, simhash

from .conftest import docs_frame
from .test_line_dedup import jaccard
from .test_simhash import brute_groups, shingle_sets

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def alike(a, b):
    one, other = shingle_sets(a), shingle_sets(b)
    return len(one & other) / len(one | other)


def substituted(rng, vocabulary, n, changed):
    while True:
        a = rng.choices(vocabulary, k=n)
        b = list(a)
        for i in rng.sample(range(n), changed):
            b[i] = rng.choice(vocabulary)
        if alike(" ".join(a), " ".join(b)) >= 0.8:
            return " ".join(a), " ".join(b)


def test_near_duplicates_at_the_least_similarity(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    kinds = [(60, 1), (100, 2), (200, 4), (200, 2)]
    pairs = [substituted(rng, vocabulary, *kind) for kind in kinds for _ in range(100)]
    for _ in range(100):  # a fifth more at the end
        a = rng.choices(vocabulary, k=100)
        pairs.append((" ".join(a), " ".join(a + rng.choices(vocabulary, k=20))))
    kept = {r["doc_id"] for r in simhash.one_of_each(docs_frame(spark, [x for p in pairs for x in p])).collect()}
    assert all(2 * k in kept for k in range(len(pairs)))
    for at in range(0, len(pairs), 100):
        assert sum(2 * k + 1 not in kept for k in range(at, at + 100)) >= 95


def test_a_family_of_templates(spark):
    """Texts hardly less alike than 0.8, few of them more: all pairs decide, whoever is nearest to whom."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    base, places = rng.choices(vocabulary, k=200), rng.sample(range(200), 8)
    values = [rng.choices(vocabulary, k=4) for _ in places]
    texts = []
    for _ in range(250):
        words = list(base)
        for own, p in zip(values, places, strict=True):
            words[p] = rng.choice(own)
        texts.append(" ".join(words))
    want = set(brute_groups(texts))
    kept = {r["doc_id"] for r in simhash.one_of_each(docs_frame(spark, texts)).collect()}
    assert want <= kept and len(kept) <= len(want) + 0.05 * (250 - len(want))
    assert len(want) < 200


def test_parts_of_any_width_find_the_same(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(900)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 60))) for _ in range(40)]
    texts += [t + " more" for t in texts[:20]]
    found = [sorted(map(tuple, simhash.near_duplicates(docs_frame(spark, texts), 4, 4, wide).collect())) for wide in (0, 1, 2)]
    assert found[0] == found[1] == found[2]
    assert [simhash.width_for(n, 4) for n in (10, 4_000_000, 4_000_001, 1 << 40)] == [0, 0, 1, 2]


@pytest.mark.parametrize("kind", ["address", "characters", "words"])
def test_lines_at_the_least_similarity(spark, kind):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices(LETTERS, k=n))
    vocabulary = [word(rng.randint(2, 9)) for _ in range(3000)]

    def pair():
        if kind == "address":
            base = f"https://www.{word(10)}.com/{word(12)}/{word(12)}"
            return base + "a", base + "b"
        while True:
            a = rng.choices(vocabulary, k=rng.randint(8, 60))
            b = list(" ".join(a)) if kind == "characters" else list(a)
            for _ in range(max(1, len(b) // 50)):
                b[rng.randrange(len(b))] = rng.choice(LETTERS) if kind == "characters" else rng.choice(vocabulary)
            one, other = " ".join(a), ("" if kind == "characters" else " ").join(b)
            if 0.8 <= jaccard(one, other) < 0.9:
                return one, other

    pairs = [pair() for _ in range(200)]
    gone = {r["doc_id"] for r in line_dedup.dropped_lines(docs_frame(spark, [x for p in pairs for x in p])).collect()}
    assert gone <= {2 * k + 1 for k in range(200)} and len(gone) >= 190
