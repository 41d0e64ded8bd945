import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from weftline.llm import suffix_dedup as S

from .conftest import docs_frame


@pytest.mark.parametrize("seed", range(30))
def test_two_stage_order(seed):
    rng = random.Random(seed)
    letters = [b"ab", b"abcdz\x00\xff", b"a"][seed % 3]
    segments = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
    segments += [segments[0], b"a" * 40][: seed % 3]
    text, bounds = b"".join(segments), np.cumsum([len(s) for s in segments])
    wanted = np.array([rng.random() < 0.6 for _ in text])
    order = S.two_stage(text, bounds, wanted, 8)
    limit = bounds[np.searchsorted(bounds, np.arange(len(text)), "right")]
    keys = [text[i : min(i + 8, limit[i])] for i in order]
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)


def brute(texts, span=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + span] for d in data for k in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - span + 1):
            if seen[d[k : k + span]] > 1:
                gone[k : k + span] = b"\x01" * span
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(d)))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def fixture():
    random.seed(9)
    word = lambda: "".join(random.choices("abcdé", k=random.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(4)]
    out = [text(random.randint(1, 120)) for _ in range(15)]
    for _ in range(25):
        p = random.choice(passages)
        cut = random.randint(0, 120)
        out.append(text(random.randint(0, 40)) + p[cut:] + text(random.randint(0, 40)))
    exact = passages[0].encode()[:199].decode(errors="ignore")
    return [*out, *out[:3], exact, "x" + exact, "ab" * 400, "z" * 1000, "y" * 200, "q" * 199, "y" * 201, None, "", passages[1] + "|" + passages[1]]


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_against_brute_force(spark, hot):
    texts = fixture()
    rows = sorted(S.remove_repeats(docs_frame(spark, texts), hot=hot, with_text=True).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows] == brute(texts)


def test_runs_cover_all_windows_and_agree():
    """Equal windows have equal keys, every window is in one run, and a key that repeats within one run says so."""
    data = np.frombuffer(("abc" * 200 + "".join(random.Random(2).choices("abcdefgh", k=900)) + "abc" * 150).encode(), np.uint8)
    key, start, count, occurs = S.minimizer_runs(data, 50, 16)
    assert start[0] == 0 and np.array_equal(start[1:], (start + count)[:-1]) and (start + count)[-1] == len(data) - 49
    of = {}
    for k, s, c in zip(key.tolist(), start.tolist(), count.tolist(), strict=True):
        for j in range(s, s + c):
            assert of.setdefault(data[j : j + 50].tobytes(), k) == k
    total = Counter()
    for k, o in zip(key.tolist(), occurs.tolist(), strict=True):
        total[k] += o
    windows = Counter(data[j : j + 50].tobytes() for j in range(len(data) - 49))
    assert all(total[of[w]] > 1 for w, n in windows.items() if n > 1)


def test_awkward(spark, awkward, nothing):
    rows = S.remove_repeats(awkward).collect()
    want = sorted((r["doc_id"], *x[:4]) if r["doc_id"] is not None else (-1, *x[:4]) for r, x in zip(awkward.collect(), brute([r["text"] for r in awkward.collect()]), strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in rows) == want
    assert S.remove_repeats(nothing).count() == 0
    again = docs_frame(spark, ["".join(map(str, range(200)))])
    assert [r["n_removed"] for r in S.remove_repeats(again.unionByName(again)).collect()] == [490, 490]


def test_keys_of_many_bytes_are_cut_anew(spark):
    """Few segments may hold as many bytes as many do: they are cut anew as well, and the result stays."""
    texts = fixture()
    rows = sorted(S.remove_repeats(docs_frame(spark, texts), hot_bytes=1000, with_text=True).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows] == brute(texts)


def test_sorting_a_group_takes_little_memory():
    """3,000 segments of one minimizer: the suffixes' texts are never cut out all at once."""
    rng = random.Random(5)
    middle = bytes(rng.choices(b"abcdefgh ", k=32))
    texts = [bytes(rng.choices(b"abcdefgh ", k=168)) + middle + bytes(rng.choices(b"abcdefgh ", k=168)) for _ in range(3000)]
    tracemalloc.start()
    hits = S.repeated_starts(texts, [169] * len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not any(h.any() for h in hits) and peak < 100e6
