import zlib

import numpy as np
import pytest

from weftline.llm import toxicity as T

from .conftest import docs_frame


def brute_segments(scores):
    """Maximal segments by their definition: take the best interval, then go on left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[0] + 1e-12):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return brute_segments(scores[:i]) + [(s, i, j)] + [(x, a + j, b + j) for x, a, b in brute_segments(scores[j:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    weights = np.where(rng.random(14) < 0.5, rng.random(14) * 3, 0)
    at = np.flatnonzero(weights)
    got = T.maximal_segments(at, weights[at], 0.7)
    want = brute_segments([w if w > 0 else -0.7 for w in weights])
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert [s for s, _, _ in got] == pytest.approx([s for s, _, _ in want])


def corpus(n=400):
    rng = np.random.default_rng(5)
    texts, toxic = [], []
    for k in range(n):
        words = [f"w{x}" for x in rng.zipf(1.4, 80) % 500]
        bad = k % 4 == 0
        if bad:
            words[20:20] = [("vile", "nasty", f"grossx{k % 7}y")[j % 3] for j in range(4)]
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy(spark):
    texts, toxic = corpus()
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    model = T.train(docs, labels)
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = [r for r in T.score(docs, model).collect() if r["doc_id"] in held]
    assert all((r["score"] >= T.THRESHOLD) == bool(toxic[r["doc_id"]]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        if toxic[r["doc_id"]]:
            assert any(p["start"] <= 20 and p["end"] >= 24 for p in r["passages"])
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not t for t in toxic)


def test_labels_of_held_out_rows_are_not_seen(spark):
    texts, toxic = corpus(120)
    docs = docs_frame(spark, texts)
    flipped = [1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t for i, t in enumerate(toxic)]
    one, other = (T.train(docs, spark.createDataFrame(list(enumerate(x)), "doc_id bigint, toxic int")) for x in (toxic, flipped))
    assert one == other


def test_without_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = T.train(awkward, labels)
    rows = T.score(awkward, model).collect()
    assert len(rows) == awkward.count() and len({r["score"] for r in rows}) == 1 and rows[0]["score"] < T.THRESHOLD
    assert T.score(nothing, model).count() == 0 and T.keep_clean(awkward, model).count() == awkward.count()
