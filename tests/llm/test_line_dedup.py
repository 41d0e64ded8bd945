import os
import random

import pytest

from weftline.llm import _shared
from weftline.llm import line_dedup as L

from .conftest import docs_frame


def jaccard(a, b):
    one, other = ({x[k : k + 5] for k in range(len(x) - 4)} or {x} for x in (a, b))
    return len(one & other) / len(one | other)


def brute(texts):
    """(doc, line) that go: components of lines of 20 characters or more at a similarity of 0.8 or more keep their first."""
    lines = [(d, k, x.strip(" ").lower()) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if len(x.strip(" ")) >= 20]
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if lines[i][2] == lines[j][2] or jaccard(lines[i][2], lines[j][2]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {lines[i][:2] for i in range(len(lines)) if root(i) != i}


def test_against_brute_force(spark):
    random.seed(3)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 9))) for _ in range(400)]
    base = [" ".join(random.choices(vocabulary, k=random.randint(8, 40))) for _ in range(40)]

    def edited(line):
        words = line.split(" ")
        for _ in range(random.randint(0, 2)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        return " ".join(words)

    texts = ["\n".join([edited(random.choice(base)) if random.random() < 0.6 else " ".join(random.choices(vocabulary, k=12)) for _ in range(6)] + ["short", ""]) for _ in range(60)]
    got = {(r["doc_id"], k) for r in L.dropped_lines(docs_frame(spark, texts)).collect() for k in r["dropped"]}
    want = brute(texts)
    assert not got - want
    assert len(got & want) >= 0.97 * len(want) > 50


def test_near_lines_keep_the_first(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank every single morning"
    texts = [f"alone in this text, nothing like it anywhere\n{line}", f"{line} now\n  {line.upper()}  ", None, f"short\n{line}"]
    out = {r["doc_id"]: r["text"] for r in L.without_repeated_lines(docs_frame(spark, texts)).collect()}
    assert out == {0: texts[0], 1: "", 2: None, 3: "short"}


def test_columns_and_awkward_rows(spark, awkward, nothing):
    out = L.without_repeated_lines(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    kept = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert kept[4] == "same line of words here, twice over" and kept[5] == "x" * 5000
    assert L.without_repeated_lines(nothing).count() == 0
    again = docs_frame(spark, ["a line that is long enough to count"])
    assert L.without_repeated_lines(again.unionByName(again)).count() == 2


def test_many_lines_that_share_a_phrase(spark):
    """One band key for all of a large group of unlike lines: none is lost, none is dropped."""
    random.seed(4)
    texts = ["exactly the same opening words of every line here " + " ".join("".join(random.choices("klmnop", k=6)) for _ in range(20)) for _ in range(300)]
    assert L.dropped_lines(docs_frame(spark, texts)).count() == 0


def test_large_families_lose_no_link(spark):
    """Lines of one template, alike in some slots: what full comparison drops goes, whichever line ends a key's group."""
    random.seed(9)
    values = [["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40)] for _ in range(3)]
    texts = ["order {} was shipped from the {} warehouse on the first working day of the month and signed for at the {} office".format(*map(random.choice, values)) for _ in range(900)]
    want = brute(texts)
    got = {(r["doc_id"], k) for r in L.dropped_lines(docs_frame(spark, texts)).collect() for k in r["dropped"]}
    assert not got - want and len(got) >= 0.99 * len(want) > 100


def test_large_families_settle_in_few_steps(spark, monkeypatch):
    """Hubs of a group are compared with at once: components are written four times at most, and no link is lost."""
    random.seed(16)
    values = [["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(20)] for _ in range(3)]
    texts = ["order {} was shipped from the {} warehouse on the first working day of the month and signed for at the {} office".format(*map(random.choice, values)) for _ in range(400)]
    names, written = [], _shared.written
    monkeypatch.setattr(_shared, "written", lambda df, name, **options: names.append(name) or written(df, name, **options))
    want = brute(texts)
    got = {(r["doc_id"], k) for r in L.dropped_lines(docs_frame(spark, texts)).collect() for k in r["dropped"]}
    assert not got - want and len(got) >= 0.99 * len(want) > 100
    assert names.count("rare-shingles") == 1 and names.count("line-components") <= 4


@pytest.mark.parametrize("bound", [None, 150])
def test_families_are_compared_by_bitmaps(spark, monkeypatch, bound):
    """Lines of large groups are not cut into shingles again unless their family is over the bound; both ways find all links."""
    random.seed(16)
    values = [["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(20)] for _ in range(3)]
    texts = ["order {} was shipped from the {} warehouse on the first working day of the month and signed for at the {} office".format(*map(random.choice, values)) for _ in range(400)]
    cut, rare = [], L._rare
    monkeypatch.setattr(L, "_rare", lambda lines, similar: cut.append(lines.count()) or rare(lines, similar))
    if bound:
        monkeypatch.setattr(L, "LARGE_GROUP", bound)
    want = brute(texts)
    got = {(r["doc_id"], k) for r in L.dropped_lines(docs_frame(spark, texts)).collect() for k in r["dropped"]}
    assert not got - want and len(got) >= 0.99 * len(want) > 100
    assert len(cut) == 1 and (cut[0] > 150 if bound else cut[0] == 0)


def test_family_pairs_name_all_that_are_alike(spark):
    """A line of the family's component is met by the others only, these by one another once, whatever their order."""
    random.seed(18)
    letters = "abcdefghijklmnopqrstuvwxyz"
    shared = "".join(random.choices(letters, k=80))
    lines = [shared + "".join(random.choices(letters, k=80)) for _ in range(300)]
    lines += [x[:-4] + "0000" for x in lines[:20]] + [x * 9 for x in lines[:3]] + [x * 9 + "0000" for x in lines[:3]]
    sketches = L.parities(spark.createDataFrame(list(enumerate(lines)), "n bigint, line string"))
    own = {*range(10), 310, 311, 312}
    families = sketches.select(L.F.lit(0).cast("bigint").alias("key"), "n", L.F.when(L.F.col("n").isin(own), 0).otherwise(L.F.col("n")).alias("component"), "size")
    rows = L._family_pairs(families, sketches, 0.8).collect()
    pairs = [(r["n"], r["m"]) for r in rows]
    alike = {(i, j) for i in range(len(lines)) for j in range(i) if (300 <= i <= 319 and j == i - 300 or i > 319 and jaccard(lines[i], lines[j]) >= 0.8) and not {i, j} <= own}
    assert len(set(pairs)) == len(pairs) < len(alike) + 100 and alike <= set(pairs) and len(alike) >= 20
    assert all(r["of"] in (r["n"], r["m"]) and r["of"] not in own for r in rows)


def test_components_of_stars_need_no_round(spark, monkeypatch):
    names, written = [], _shared.written
    monkeypatch.setattr(_shared, "written", lambda df, name, **options: names.append(name) or written(df, name, **options))
    found = _shared.components(spark.createDataFrame([(5, 1), (1, 7), (7, 1), (8, 2), (3, 3), (8, 8)], "u bigint, v bigint"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (3, 3), (5, 1), (7, 1), (8, 2)]
    assert len(names) == 1


def test_lines_of_few_words(spark):
    words = ["".join(random.choices("abcdefghij", k=60)) for _ in range(40)]
    texts = [edge + w for w in words for edge in ("1", "2")]
    assert {r["doc_id"] for r in L.dropped_lines(docs_frame(spark, texts)).collect()} == {2 * k + 1 for k in range(40)}


def test_edits_among_the_sampled_shingles(spark):
    """Lines at 0.9 whose sampled shingles mostly hold the one character that differs."""
    random.seed(12)
    few = "abcefghijkmnopqrsuvwxyz"
    texts = []
    for _ in range(40):
        left, cluster, right = ("".join(random.choices(x, k=k)) for x, k in ((few, 45), ("dlt", 14), (few, 45)))
        texts += [left + cluster + right, left + cluster[:7] + "z" + cluster[8:] + right]
    assert all(jaccard(*texts[k : k + 2]) > 0.89 for k in range(0, 80, 2))
    assert len({r["doc_id"] for r in L.dropped_lines(docs_frame(spark, texts)).collect() if r["doc_id"] % 2}) >= 39


def test_bitmaps_rule_out_nothing_alike(spark):
    random.seed(13)
    lines = []
    for size in (3, 30, 200, 1999, 2004, 2010, 17000):
        line = [random.choice("abcdef") for _ in range(size)] if size < 1000 else [random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)]
        lines.append("".join(line))
        for share in (0.005, 0.02, 0.03, 0.2):
            edited = list(line)
            for k in random.sample(range(size), int(share * size)):
                edited[k] = "#"
            lines.append("".join(edited) + random.choice(["", line[0] * 3, "".join(line[: size // 10])]))
    known = spark.createDataFrame(list(enumerate(lines)), "n bigint, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i)], "n bigint, n_ bigint")
    left = {(r["n"], r["n_"]): r["bits"] for r in L._near(pairs, L.parities(known), 0.8).collect()}
    alike = {(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.8}
    assert alike <= set(left) and len(alike) > 15 and len(left) < 100


def test_large_groups_are_not_paired_out(spark):
    """600 lines that share a phrase of two thirds: rare shingles name few pairs, those that are alike among them."""
    random.seed(14)
    shared = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=80))
    lines = [shared + "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(600)]
    lines += [x[:-4] + "0000" for x in lines[:20]]
    known = spark.createDataFrame(list(enumerate(lines)), "n bigint, line string")
    keys = L._rare(known, 0.8).join(L.parities(known).select("n", "size"), "n").withColumn("component", L.F.col("n"))
    pairs = {(r["n"], r["n_"]) for r in L._pairs(keys, 0.8, ranked=True).collect()}
    assert {(600 + k, k) for k in range(20)} <= pairs and len(pairs) < 1000


def test_folded_bitmaps_rule_pairs_out_where_they_meet(spark):
    """400 lines of one key that share half of their text: the join itself names those alike and hardly any others."""
    random.seed(15)
    letters = "abcdefghijklmnopqrstuvwxyz"
    shared = "".join(random.choices(letters, k=80))
    lines = [shared + "".join(random.choices(letters, k=80)) for _ in range(400)]
    lines += [x[:-4] + "0000" for x in lines[:20]] + [x * 9 for x in lines[:3]] + [x * 9 + "0000" for x in lines[:3]]
    sketches = L.parities(spark.createDataFrame(list(enumerate(lines)), "n bigint, line string"))
    keys = sketches.select(L.F.lit(1).alias("key"), "n", "size", L.F.col("n").alias("component"))
    pairs = {(r["n"], r["n_"]) for r in L._pairs(keys.join(L._folded(sketches), "n"), 0.8).collect()}
    alike = {(i, j) for i in range(len(lines)) for j in range(i) if 400 <= i <= 419 and j == i - 400 or i > 419 and jaccard(lines[i], lines[j]) >= 0.8}
    assert alike <= pairs and len(alike) >= 23 and len(pairs) < len(alike) + 100


def test_little_goes_into_the_join_of_all_pairs(spark):
    """Each key of a line takes its bitmap along: 32 bytes, still the parities of the whole."""
    line = "".join(random.Random(17).choices("abcdefghijklmnopqrstuvwxyz", k=3000))
    sketches = L.parities(spark.createDataFrame([(1, line), (2, line[:200])], "n bigint, line string"))
    folded = {r["n"]: r[1:] for r in L._folded(sketches).collect()}
    for n, odd in ((r["n"], r["odd"]) for r in sketches.collect()):
        want = [0] * 4
        for k, x in enumerate(odd):
            want[k % 4] ^= x
        assert list(folded[n]) == want


def test_only_the_result_is_left_on_disk(spark):
    folder = _shared.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    L.dropped_lines(docs_frame(spark, ["one line that is long enough to count", "one line that is long enough to count!"])).collect()
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["dropped"]


def test_native_plan(spark):
    plan = L.dropped_lines(docs_frame(spark, ["some line that is long enough"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize(("a", "b", "alike"), [("abcdefghijklmnopqrst", "abcdefghijklmnopqrst", 1.0), ("abcdefghij", "abcdefghiX", 5 / 7), ("abc", "abc", 1.0)])
def test_jaccard(spark, a, b, alike):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    one, other = (set(x) for x in row.select(L.shingles(row.a), L.shingles(row.b)).first())
    assert len(one & other) / len(one | other) == pytest.approx(alike)
