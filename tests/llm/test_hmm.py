import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from weftline.llm import hmm

from .conftest import docs_frame


def test_forward_against_all_paths():
    rng = np.random.default_rng(1)
    model = hmm.Model(*(rng.dirichlet(np.ones(3)) for _ in range(2)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    for text in ([4], [0, 1], [2, 2, 3, 1, 0], [1, 4, 4, 0]):
        total = 0.0
        for path in product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for a, b, s in zip(path, path[1:], text[1:], strict=False):
                p *= model.move[a, b] * model.emit[s, b]
            total += p
        got = hmm.log_likelihoods(model, [np.array([1, 2, 0, 3]), np.array(text), np.array([0])])
        assert got[1] == pytest.approx(math.log(total))


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(2)
    model = hmm.Model(*(rng.dirichlet(np.ones(2)) for _ in range(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T)
    texts, starts = [np.array([0, 2, 1]), np.array([1, 1]), np.array([2])], [True, False, True]
    want = {"start": np.zeros(2), "middle": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((3, 2))}
    for text, is_start in zip(texts, starts, strict=True):
        weights = {}
        for path in product(range(2), repeat=len(text)):
            p = (model.start if is_start else model.middle)[path[0]] * model.emit[text[0], path[0]]
            for a, b, s in zip(path, path[1:], text[1:], strict=False):
                p *= model.move[a, b] * model.emit[s, b]
            weights[path] = p
        for path, p in weights.items():
            p /= sum(weights.values())
            want["start"][path[0]] += p * is_start
            for s, a in zip(text, path, strict=True):
                want["emit"][s, a] += p
                want["middle"][a] += p
            for a, b in zip(path, path[1:], strict=False):
                want["move"][a, b] += p
    got = {k: np.zeros_like(v) for k, v in want.items()}
    hmm.expected_counts(model, texts, np.array(starts), got)
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


def brute_base(texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    split = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in split.items()}


@pytest.mark.parametrize(("head", "symbols"), [(60_000, 8192), (30, 8)])
def test_base_and_gain(spark, head, symbols):
    """Texts in two manners: the model must tell them apart and beat the base, also on texts that it never saw."""
    rng = np.random.default_rng(3)
    manners = [[f"aa{i}" for i in range(40)], [f"zz{i}" for i in range(40)]]
    texts = {i: " ".join(rng.choice(manners[i % 2], 60)) + (f" Rare{i} onlyhere{i % 9}" if i % 3 else "") for i in range(120)}
    rows = hmm.score_corpus(docs_frame(spark, list(texts.values())), states=4, head=head, symbols=symbols).collect()
    want = brute_base(texts)
    for r in rows:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4])
    if symbols > 1000:
        held = [r for r in rows if r["held_out"]]
        assert held and sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_rounds_raise_the_likelihood(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"{'abc'[i % 3]}{k}" for k in range(20)], 50)) for i in range(60)]
    totals = [sum(r["score"] for r in hmm.score_corpus(docs_frame(spark, texts), states=3, rounds=n).collect() if not r["held_out"]) for n in (1, 2, 4)]
    assert totals == sorted(totals)


def test_awkward(spark, awkward, nothing):
    rows = hmm.score_corpus(awkward, states=2, rounds=1).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r["score"]) and r["n_tokens"] > 0 for r in rows)
    assert hmm.score_corpus(nothing, states=2, rounds=1).count() == 0
    alone = hmm.score_corpus(docs_frame(spark, ["x"], first=next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)), states=2, rounds=1).first()
    assert (alone["held_out"], alone["n_known"], alone["train_tokens"], alone["base_score"]) == (True, 0, 0, 0.0)
