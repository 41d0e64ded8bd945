import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import quality as Q

from .conftest import docs_frame


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = [any(0 <= i <= len(words) - 3 and seen[tuple(words[i : i + 3])] > 1 for i in (k - 2, k - 1, k)) for k in range(len(words))]
    lines = [x for x in text.split("\n")]
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(cover)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "😀", "|x"]), max_size=60).map("".join))
def test_counts_against_brute_force(text):
    assert Q.text_stats(text)[:5] == brute_stats(text)


def test_repeats_with_many_words():
    words = np.array([*range(5), *range(3), *range(1 << 21, (1 << 21) + 3)])
    assert Q.repeated_words(words) == 6


def test_em_finds_the_accuracies():
    """Votes drawn from known rules: the estimated tables must come near, and beat counting votes."""
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    rates = [(0.02, 0.6), (0.01, 0.5), (0.1, 0.3), (0.02, 0.7)]
    votes = np.stack([np.where(rng.random(20_000) < np.where(good, a, b), -1, np.where(rng.random(20_000) < 0.8, 1, 0)) for a, b in rates], 1)
    share, table = Q.fit(list(Counter(map(tuple, votes.tolist())).items()), 4)
    assert share == pytest.approx(0.8, abs=0.03)
    for k, (a, b) in enumerate(rates):
        assert (table[1, k, 0], table[0, k, 0]) == (pytest.approx(a, abs=0.05), pytest.approx(b, abs=0.08))


def test_clean_stays_and_junk_goes(spark):
    random.seed(2)
    vocabulary = ["".join(random.choices("abcdefghijklm", k=random.randint(2, 8))) for _ in range(2000)]
    clean = [". \n".join(" ".join(random.choices(vocabulary, k=12)) for _ in range(random.randint(6, 30))) + "." for _ in range(150)]
    junk = ["\n".join([" ".join(f"{w}###" for w in random.choices(vocabulary, k=60))] * 2) for _ in range(15)]
    repeats = ["\n".join(["buy this now and pay later"] * 40)] * 5
    rows = {r["doc_id"]: r for r in Q.judge(docs_frame(spark, clean + junk + repeats)).collect()}
    assert all(rows[k]["kept"] for k in range(150)) and not any(rows[k]["kept"] for k in range(150, 170))
    assert all(rows[k]["base_failed"] for k in range(165, 170)) and all(0 <= r["posterior"] <= 1 for r in rows.values())


def test_awkward(spark, awkward, nothing):
    rows = Q.judge(awkward).collect()
    assert len(rows) == awkward.count() and not any(r["kept"] for r in rows if r["n_words"] < 50)
    by = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert by == sorted(brute_stats(r["text"]) for r in awkward.collect())
    assert Q.judge(nothing).count() == 0
