import random

import numpy as np
import pytest

from weftline.llm import decontaminate as D

from .conftest import docs_frame

random.seed(7)
VOCABULARY = ["".join(random.choices("abcdefghij", k=5)) for _ in range(3000)]
ITEMS = [" ".join(random.choices(VOCABULARY, k=random.randint(15, 60))) for _ in range(30)] + ["too few words", None]


def bench(spark):
    return spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string")


def filler(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def brute_alignment(doc, item):
    """Most words of the item that match a document in one place, without gaps."""
    return max((sum(doc[s + i] == item[i] for i in range(len(item)) if 0 <= s + i < len(doc)) for s in range(-len(item), len(doc))), default=0)


def test_exact_and_substituted_passages(spark):
    docs, want = [filler(300) for _ in range(20)], set()
    for k in range(30):
        words = ITEMS[k].split()
        if k % 3:
            for i in random.sample(range(len(words)), len(words) // 10):
                words[i] = "changed"
        docs.append(filler(random.randint(0, 200)) + " " + " ".join(words).upper() + ". " + filler(50))
        want.add((20 + k, k))
    rows = D.contaminated(docs_frame(spark, docs), bench(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    for r in rows:
        most = brute_alignment(D.tokens(docs[r["doc_id"]]), D.tokens(ITEMS[r["item_id"]]))
        assert most - 2 <= r["matched"] <= most  # a match beyond a substitution at the edge does not pay
        assert r["doc_end"] - r["doc_start"] >= r["matched"]
    kept = D.without_contaminated(docs_frame(spark, docs), bench(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_insertions_split_a_passage(spark):
    words = ITEMS[2].split()
    text = filler(30) + " " + " ".join(words[:10]) + " extra words " + " ".join(words[10:]) + " " + filler(30)
    row = D.contaminated(docs_frame(spark, [text]), bench(spark)).first()
    assert (row["item_id"], row["matched"]) == (2, len(words))


@pytest.mark.parametrize(("size", "replaced"), [(30, range(12, 18)), (20, range(8, 12)), (12, [5]), (7, [3]), (10, [2, 6]), (13, [0, 6])])
def test_several_words_in_a_row_and_short_items(size, replaced):
    item = " ".join(random.sample(VOCABULARY, size))
    words = [f"other{i}" if i in replaced else w for i, w in enumerate(item.split())]
    index = D.Index([(5, item)])
    ids = np.array([index.vocab.get(w, -1) for w in D.tokens("before it " + " ".join(words) + " after it")])
    assert [x[:3] for x in index.overlaps(ids)] == [(5, size, size - len(replaced))]


def test_short_overlaps_are_left_alone(spark):
    text = filler(40) + " " + " ".join(ITEMS[0].split()[:9]) + " " + filler(40)
    assert D.contaminated(docs_frame(spark, [text, "too few words"]), bench(spark)).count() == 0


def test_blocks_of_the_benchmark_agree(spark):
    docs = docs_frame(spark, [ITEMS[k] + " " + filler(20) for k in range(30)])
    one = D.contaminated(docs, bench(spark)).collect()
    many = D.contaminated(docs, bench(spark), block_bytes=500).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 30
    assert D.without_contaminated(docs, bench(spark), block_bytes=500).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_best_stretch(seed):
    same = np.random.default_rng(seed).random(12) < 0.6
    score = lambda a, b: sum(1 if x else -2 for x in same[a:b])
    a, b = D.best_stretch(same)
    assert score(a, b) == max(score(i, j) for i in range(13) for j in range(i, 13))


def test_awkward(spark, awkward, nothing):
    assert D.contaminated(awkward, bench(spark)).count() == 0 and D.contaminated(nothing, bench(spark)).count() == 0
    assert D.without_contaminated(awkward, bench(spark)).columns == awkward.columns
    assert D.contaminated(awkward, bench(spark).where("false")).count() == 0
    twice = bench(spark).unionByName(bench(spark))
    assert D.contaminated(docs_frame(spark, [ITEMS[0]]), twice).count() == 2
