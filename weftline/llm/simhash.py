"""SimHash near-duplicates found through the anchor points of a covering code.

Parts of the 64 bits are taken such that two fingerprints within the threshold differ in at most one bit of some part.
On a part the anchors are the words of a covering code: a Hamming code on its first bits, every word on the few that
are left; its covering radius is 1. A fingerprint is at home at its nearest anchor and replicated to every anchor within
radius plus threshold, 1 + 1 bits, so both of a close pair meet at the home of either. Homes are compared with all that
came to the anchor; a group's links leave it as a spanning forest, never as all pairs, and a distributed union-find
joins the forests.

The parts' width, and with it the number of anchors, follows the number of fingerprints, so that groups stay about as
large whatever the input: three ranges of 21 or 22 bits and a Hamming code of length 15 (44 copies a fingerprint, 2^17
anchors a part), then unions of ranges of 32 and of 40 bits. Every width finds the same links.

``one_of_each`` decides by the similarity of texts, not of fingerprints. Its fingerprints are longer, over pairs of
words, and cut into as many parts as let a pair at the least similarity meet nine times in ten, one more alike for all
but certain. What meets is compared by other words of the fingerprint, and exactly by the sets of shingles after that.
Fingerprints settle nearly all families; what texts of different components they leave apart is found exactly, where
the least hashes of their shingles meet (prefix filter), so that no link is lost.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared
from weftline.llm._worker import worker_memory

MOST_BITS = 4
#: Fingerprints up to which the narrowest parts serve; each wider kind serves 512 times as many.
WIDE_FROM = 4_000_000
WIDEST = 2
PAIRS_AT_ONCE = 2_000_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 with seed 42 of every shingle of ``width`` words, repeats included; of the whole sequence where words are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    bounds = zip((ends - sizes + 1)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in bounds), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


Part = list[tuple[int, int]]


def _ranges(n: int) -> Part:
    cuts = [-(-64 * i // n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _spreads(most: int, n: int):
    """All ways to spread ``most`` differences over ``n`` ranges."""
    if n == 1:
        yield (most,)
        return
    for k in range(most + 1):
        for rest in _spreads(most - k, n - 1):
            yield (k, *rest)


def parts_of(most: int, wide: int = 0) -> list[Part]:
    """Parts as lists of (lowest bit, width) such that ``most`` differences leave one of them with one at most.

    Wide parts are unions of all but ``most`` - 1 (or a few more) of the ranges, chosen greedily until every way to spread
    the differences over the ranges is covered. ``wide`` is 0, 1 or 2.
    """
    if not 0 <= most <= 7 or wide and most > 5:
        raise ValueError("the threshold must be from 0 to 7 bits, to 5 with wide parts")
    if not wide:
        return [[r] for r in _ranges(max(3, most // 2 + 1))]
    n, some = (max(6, most + 2), 3) if wide == 1 else (max(8, most + 4), 5)
    ranges = _ranges(n)
    left = set(_spreads(most, n))
    unions = list(combinations(range(n), some))
    chosen = []
    while left:
        best = max(unions, key=lambda u: sum(sum(x[i] for i in u) <= 1 for x in left))
        chosen.append([ranges[i] for i in best])
        left = {x for x in left if sum(x[i] for i in best) > 1}
    return chosen


def width_for(n: int, most: int) -> int:
    """How wide parts must be for ``n`` fingerprints."""
    wide = 0
    while wide < WIDEST and most <= 5 and n > WIDE_FROM << 9 * wide:
        wide += 1
    return wide


def part_value(fps: np.ndarray, part: Part) -> tuple[np.ndarray, int]:
    """The part's bits side by side, and how many they are."""
    bits, out, at = fps.view(np.uint64), np.zeros(len(fps), np.int64), 0
    for low, width in part:
        out |= ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) << at
        at += width
    return out, at


def code_length(bits: int) -> int:
    """Of the longest Hamming code that fits."""
    return (1 << (bits + 1).bit_length() - 1) - 1


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def fingerprints(docs: DataFrame, width: int = 4, repeats: bool = True) -> DataFrame:
    """``doc_id, row, fp`` per row; null and empty texts have fingerprint 0. ``row`` is a hash of doc_id and text.

    Without ``repeats`` each distinct shingle counts once.
    """

    def run(batches):
        for b in batches:
            hashes = (shingle_hashes(t.as_py(), width) for t in b.column(1))
            fps = [fingerprint(h if repeats else np.unique(h)) for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], ["doc_id", "row", "fp"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, row bigint, fp bigint")


def syndromes(words: np.ndarray, length: int) -> np.ndarray:
    """Under the Hamming code whose check column of bit i is i + 1; 0 for code words."""
    out = np.zeros(len(words), np.int64)
    for i in range(length):
        out ^= np.where(words >> i & 1, i + 1, 0)
    return out


def moves(bits: int) -> list[np.ndarray]:
    """By syndrome: the bit flips (home first) that lead from a part's value to every anchor within two bits."""
    length = code_length(bits)
    free = [1 << i for i in range(length, bits)]
    near = [[0, *free, *(a | b for a, b in combinations(free, 2))]]
    for s in range(1, length + 1):
        near.append([1 << (s - 1), *(1 << (s - 1) | f for f in free), *(1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, length + 1) if i < i ^ s <= length)])
    return [np.array(x, np.int64) for x in near]


def anchor_rows(fps: np.ndarray, most: int = MOST_BITS, wide: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, fingerprint, home (1 or 0) of every copy that is sent out."""
    anchors, copies, home = [], [], []
    for number, part in enumerate(parts_of(most, wide)):
        value, bits = part_value(fps, part)
        found = syndromes(value, code_length(bits))
        for s, flips in enumerate(moves(bits)):
            own = found == s
            if own.any():
                at = value[own][:, None] ^ flips[None, :]
                anchors.append((at | number << 48).ravel())
                copies.append(np.repeat(fps[own], len(flips)))
                is_home = np.zeros(at.shape, np.int8)
                is_home[:, 0] = 1
                home.append(is_home.ravel())
    none = [np.zeros(0, np.int64)]
    return np.concatenate(anchors or none), np.concatenate(copies or none), np.concatenate(home or [np.zeros(0, np.int8)])


class Stars:
    """Union-find over numbers; holds what has been linked only, and the links that joined what was apart."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))
            self.links.append((x, y))


def _bounds(anchor: np.ndarray) -> np.ndarray:
    """Where each run of equal anchors begins, and the end."""
    return np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True]))) if len(anchor) else np.zeros(1, np.int64)


def link_groups(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, stars: Stars, most: int = MOST_BITS) -> None:
    """Links fingerprints at most ``most`` bits apart that meet at an anchor, one of them at home there.

    Groups are taken in blocks of at most ``PAIRS_AT_ONCE`` comparisons; of the links only those that join what was apart
    are kept. In a large group a home is compared with what isn't joined to it yet, until all of it is one.
    """
    order = np.lexsort((-home, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    bounds = _bounds(anchor)
    first, size = bounds[:-1], np.diff(bounds)
    homes = np.add.reduceat(home.astype(np.int64), first) if len(first) else size
    keep = (homes > 0) & (size > 1)
    first, size, homes = first[keep], size[keep], homes[keep]
    small = homes * size <= 4096
    at = 0
    f, n, h = first[small], size[small], homes[small]
    while at < len(f):
        upto = at + max(1, int(np.searchsorted(np.cumsum(h[at:] * n[at:]), PAIRS_AT_ONCE, "right")))
        who = np.repeat(np.arange(at, upto), h[at:upto])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(h[at:upto]) - h[at:upto], h[at:upto])
        left = np.repeat(f[who] + nth, n[who])
        right = np.repeat(f[who], n[who]) + np.arange(len(left)) - np.repeat(np.cumsum(n[who]) - n[who], n[who])
        hit = (left != right) & (np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= most)
        for a, b in zip(fp[left[hit]].tolist(), fp[right[hit]].tolist(), strict=True):
            stars.link(a, b)
        at = upto
    for f, n, h in zip(first[~small].tolist(), size[~small].tolist(), homes[~small].tolist(), strict=True):
        own = fp[f : f + n]
        label = np.arange(n)
        for i in range(h):
            others = np.flatnonzero(label != label[i])
            if not len(others):
                break
            near = others[np.bitwise_count((own[others] ^ own[i]).view(np.uint64)) <= most]
            if len(near):
                apart, where = np.unique(label[near], return_index=True)
                for j in near[where].tolist():
                    stars.link(int(own[i]), int(own[j]))
                label[np.isin(label, apart)] = label[i]


def links(fps: DataFrame, most: int = MOST_BITS, wide: int | None = None) -> DataFrame:
    """``u, v``: spanning links among the distinct fingerprints (column ``fp``) at most ``most`` bits apart."""
    if wide is None:
        wide = width_for(fps.count(), most)

    def spread(batches):
        for b in batches:
            anchors, copies, home = anchor_rows(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), most, wide)
            for i in range(0, len(anchors), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(anchors[i : i + 65536]), pa.array(copies[i : i + 65536]), pa.array(home[i : i + 65536])], ["anchor", "fp", "home"])

    def compare(batches):
        for anchor, fp, home in _whole_groups(batches, 1 << 20):
            stars = Stars()
            link_groups(anchor, fp, home, stars, most)
            edges = list(set(stars.links))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], ["u", "v"])

    copies = fps.select("fp").mapInArrow(spread, "anchor bigint, fp bigint, home tinyint")
    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u bigint, v bigint")


def _whole_groups(batches, rows: int, shift: int = 0, split: bool = False):
    """The columns of sorted batches in blocks of about ``rows`` rows that end with a group of the first one (shifted right).

    A group of more rows is one block, or, with ``split``, several: memory stays bounded then.
    """
    held: list[list[np.ndarray]] = []
    n = 0

    def joined():
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= rows:
                whole = joined()
                key = whole[0] >> shift
                cut = int(np.searchsorted(key, key[-1]))
                if cut or split:
                    cut = cut or n
                    yield [x[:cut] for x in whole]
                held, n = [[x[cut:] for x in whole]], n - cut
    if n:
        yield joined()


def _classes(docs: DataFrame, width: int, most: int, wide: int | None) -> tuple[DataFrame, DataFrame]:
    """Fingerprints per row, and each distinct fingerprint with its ``least`` doc_id and its ``component``."""
    prints, _ = _shared.written(fingerprints(docs, width), "fingerprints")
    classes, _ = _shared.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = _shared.components(links(classes, most, wide), "simhash")
    return prints, classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, width: int = 4, most: int = MOST_BITS, wide: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id``: one row per input row; fingerprints at most ``most`` (up to 7) bits apart are linked.

    ``component_id`` is the smallest doc_id that can be reached over links, the row's own included. Rows with equal
    fingerprints (exact copies, texts without words) are one class from the start, so copies never meet pair by pair.
    Rows with a null doc_id keep their fingerprint and reach others, but are nobody's smallest. An empty table gives
    an empty result; columns other than doc_id and text are ignored. ``wide`` sets the parts' width, which otherwise
    follows the number of fingerprints; the result is the same.
    """
    prints, named = _classes(docs, width, most, wide)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named, _ = _shared.written(named.join(least, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# Near-duplicates by similarity of texts.

CODED = 15
#: Bits among the two words of a fingerprint that are compared; 0.8 similar texts differ in 19 on the average, 4 deviations below.
MOST_OF_128 = 33
#: A group of more rows is compared in blocks of this size and settled by rare shingles.
GROUP_ROWS = 1 << 15
#: Texts that one of their least shingles joins; where there are more, their rarest shingles settle them.
MOST_AT_SHINGLE = 64
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = (xxhash.xxh64_intdigest(word, 42) ^ 1 << 63) - (1 << 63)  # signed, as numpy takes these faster
        return h

    def of(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        words = (text or "").encode().lower().split()
        return words, np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def word_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of all runs of ``width`` words, sorted; of the whole sequence where words are fewer."""
    k = min(width, len(hashes))
    if not k:
        return hashes
    n = len(hashes) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = mixed(x * np.uint64(MIX[0]) + hashes[i : i + n])
    return np.unique(x)


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` words of 64 bits, each set where over half of the hashes, mixed anew for each word, have it set."""
    counts = np.zeros(64 * words, np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(MIX[0])
    for at in range(0, len(hashes), 2048):
        block = mixed(hashes[at : at + 2048, None] + step[None, :]).astype("<u8").view(np.uint8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


class Plan:
    """Parts for ``n`` texts, of ``CODED`` bits under the Hamming code and ``exact`` bits more.

    Texts of similarity ``similar`` (equally long, changed at one stretch) share cos = 2s / (1 + s) of their pairs of words,
    so each bit differs with probability arccos(cos) / pi; scattered changes touch fewer pairs of words than shingles and
    are met more often. The exact bits keep the comparisons of a text at an anchor within some thousands.
    """

    def __init__(self, n: int, similar: float, met: float = 0.9):
        self.exact = max(6, math.ceil(math.log2(max(n, 2))) - 20)
        p = math.acos(min(1.0, 2 * similar / (1 + similar))) / math.pi
        hit = (1 - p) ** self.exact * ((1 - p) ** CODED + CODED * p * (1 - p) ** (CODED - 1))
        self.parts = max(1, round(math.log(1 - met) / math.log1p(-hit))) if hit < met else 1
        self.width = CODED + self.exact
        self.per_word = 64 // self.width
        self.words = max(3, -(-self.parts // self.per_word))

    def spread(self, prints: np.ndarray):
        """Anchor (twice, plus 1 for what isn't at home), number of the row and the two words that are compared, part by part."""
        flips = _CODE_MOVES
        for number in range(self.parts):
            word, nth = divmod(number, self.per_word)
            value = ((prints[:, word].view(np.uint64) >> np.uint64(nth * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            found = syndromes(value, CODED)
            one, two = prints[:, (word + 1) % self.words], prints[:, (word + 2) % self.words]
            for some, moves_ in ((found == 0, flips[:1]), (found > 0, flips[1:])):
                rows = np.flatnonzero(some)
                if len(rows):
                    table = np.stack(moves_)[np.maximum(found[rows] - 1, 0)]
                    at = ((value[rows][:, None] ^ table) | number << 48) << 1 | 1
                    at[:, 0] ^= 1
                    again = np.repeat(rows, at.shape[1])
                    yield at.ravel(), again, one[again], two[again]


_CODE_MOVES = moves(CODED)


def _met(texts: DataFrame, plan: Plan) -> DataFrame:
    """``n, m, bits``: of each of ``texts`` (n, w0, w1, ...) the nearest and the first text that it meets."""
    columns = [f"w{k}" for k in range(plan.words)]

    def spread(batches):
        for b in batches:
            if b.num_rows:
                n, *words = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                for anchor, rows, one, two in plan.spread(np.stack(words, 1)):
                    for i in range(0, len(anchor), 65536):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[i : i + 65536], n[rows[i : i + 65536]], one[i : i + 65536], two[i : i + 65536])], ["anchor", "n", "one", "two"])

    def compare(batches):
        for anchor, n, one, two in _whole_groups(batches, 4 * GROUP_ROWS, 1, split=True):
            for found in _compared(anchor, n, one, two):
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int32))], ["n", "m", "bits"])

    copies = texts.select("n", *columns).mapInArrow(spread, "anchor bigint, n bigint, one bigint, two bigint")
    return copies.repartition(F.shiftright("anchor", 1)).sortWithinPartitions("anchor").mapInArrow(compare, "n bigint, m bigint, bits int")


def _compared(anchor: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray):
    """The nearest and the first (n, m, bits) that each text at home in a group meets there, in a large group in its block."""
    bounds = _bounds(anchor >> 1)
    first, size = bounds[:-1], np.diff(bounds)
    group = np.repeat(np.arange(len(first)), size)
    # Homes come first in a group; larger ones than GROUP_ROWS are taken block by block.
    unit = np.flatnonzero((anchor & 1 == 0) & (size > 1)[group])
    start = first[group[unit]] + (unit - first[group[unit]]) // GROUP_ROWS * GROUP_ROWS
    width = np.minimum(bounds[group[unit] + 1], start + GROUP_ROWS) - start
    total = np.cumsum(width)
    at = 0
    while at < len(unit):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        some = slice(at, upto)
        at = upto
        left = np.repeat(unit[some], width[some])
        right = np.repeat(start[some], width[some]) + np.arange(len(left)) - np.repeat(total[some] - width[some] - (total[some.start] - width[some.start]), width[some])
        keep = np.flatnonzero(n[left] != n[right])
        left, right = left[keep], right[keep]
        bits = np.bitwise_count((one[left] ^ one[right]).view(np.uint64)).astype(np.int64) + np.bitwise_count((two[left] ^ two[right]).view(np.uint64))
        hit = np.flatnonzero(bits <= MOST_OF_128)
        if not len(hit):
            continue
        left, right, bits = left[hit], right[hit], bits[hit]
        for by in (np.lexsort((n[right], bits, left)), np.lexsort((n[right], left))):
            heads = by[_bounds(left[by])[:-1]]
            yield n[left[heads]], n[right[heads]], bits[heads]


def _alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have a Jaccard similarity of ``similar`` or more."""

    def run(batches):
        for b in batches:
            (a, x), (c, y) = ((col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)) for col in (b.column(2), b.column(3)))
            keep = []
            for k in range(b.num_rows):
                one, two = x[a[k] : a[k + 1]], y[c[k] : c[k + 1]]
                common = len(np.intersect1d(one, two, assume_unique=True)) if min(len(one), len(two)) >= similar * max(len(one), len(two)) else 0
                keep.append(common >= similar * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("n").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("n").alias("v"), F.col("set").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _rare_meetings(sets: DataFrame, similar: float) -> DataFrame:
    """``u, v``: pairs of different components that share one of their rarest shingles, of which two texts alike share one for certain."""
    each = sets.select("n", "component", F.size("set").alias("size"), F.explode("set").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    some = each.join(often, "key").groupBy("n", "component", "size").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared"))
    first = F.col("size") - F.ceil(F.lit(similar) * F.col("size") - 1e-6) + 1
    # Shingles of one text alone are the rarest of all and meet nothing.
    left = F.greatest(F.lit(0), first - (F.col("size") - F.size("shared"))).cast("int")
    rare = some.select("n", "component", "size", F.explode(F.slice("shared", F.lit(1), left)).alias("x")).select("x.key", "n", "component", "size")
    other = rare.select("key", *(F.col(c).alias(f"{c}_") for c in ("n", "component", "size")))
    near = (F.col("n") > F.col("n_")) & (F.col("component") != F.col("component_")) & (F.least("size", "size_") >= F.lit(similar) * F.greatest("size", "size_"))
    return rare.join(other, "key").where(near).select(F.col("n").alias("u"), F.col("n_").alias("v")).distinct()


def _common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """A bitmap of 2 MB over the first 24 bits of shingles, set for those of eight texts or more among a sixteenth of ``docs``.

    It only tells which shingles come last when a text's least are taken. Any order finds the same links, so the sample
    decides nothing but how many texts meet.
    """

    def run(batches):
        memory = worker_memory().setdefault("words", Words())
        for b in batches:
            for text in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(word_runs(memory.of(text.as_py())[1], width).view(np.int64))], ["x"])

    some = _rows(docs).where("pmod(row, 16) = 0").select("text").mapInArrow(run, "x bigint")
    common = some.groupBy("x").agg(F.count(F.lit(1)).alias("texts")).where("texts >= 8").select(F.shiftrightunsigned("x", 40).alias("at"))
    blocks = common.groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    table = np.zeros((512, 4096), np.uint8)
    for r in blocks.collect():  # 512 rows of 4 KB at most
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def _least_shingles(docs: DataFrame, width: int, similar: float) -> DataFrame:
    """doc_id, row, size, keys: how many distinct shingles a text has, and so many of the least, common ones last, that two texts alike share one."""
    common = _shared.Shared(docs.sparkSession, _common_shingles(docs, width))

    def last(x, table):
        at = (x >> np.uint64(40)).astype(np.int64)
        return x[np.argsort(table[at >> 3] >> (at & 7).astype(np.uint8) & 1, kind="stable")]

    def run(batches):
        memory, table = worker_memory().setdefault("words", Words()), common.value
        for b in batches:
            sets = [word_runs(memory.of(t.as_py())[1], width) for t in b.column(1)]
            some = [last(x, table)[: len(x) - math.ceil(similar * len(x) - 1e-9) + 1].view(np.int64) for x in sets]
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in some], dtype=np.int64))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(some) if some else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(x) for x in sets], pa.int32()), keys], ["doc_id", "row", "size", "keys"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, row bigint, size int, keys array<bigint>")


def _least_meetings(docs: DataFrame, named: DataFrame, width: int, similar: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``u, v`` of texts (``named``: n, first, component) of different components that can be alike, and ``n`` of those that rare shingles must settle.

    Two texts alike share one of their least shingles, of which both have enough left for all they must share: the first
    they share is such. Where few texts meet at it the pair is named; else both are among those left to rare shingles.
    """
    of = named.select("n", "component", F.coalesce("first.doc_id", F.lit(-1)).alias("d"), F.col("first.row").alias("r"))
    found = _least_shingles(docs, width, similar).withColumn("d", F.coalesce("doc_id", F.lit(-1))).withColumnRenamed("row", "r")
    spread = found.join(of, ["d", "r"]).select("n", "component", "size", F.posexplode("keys").alias("at", "key"))
    # Dealt once: counted and joined where they are.
    spread = spread.select("key", "n", "component", "size", (F.col("size") - F.col("at")).alias("rest")).repartition("key")
    mixed = spread.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("texts")).where("low < high")
    groups, _ = _shared.written(spread.join(mixed.select("key", "texts").hint("shuffle_hash"), "key"), "least-shingles")
    few = groups.where(F.col("texts") <= MOST_AT_SHINGLE).drop("texts")
    other = few.select("key", *(F.col(c).alias(f"{c}_") for c in few.columns if c != "key"))
    both = F.lit(similar / (1 + similar) - 1e-9) * (F.col("size") + F.col("size_"))
    met = few.join(other, "key").where((F.col("n") > F.col("n_")) & (F.col("component") != F.col("component_")) & (F.least("rest", "rest_") >= both))
    return met.select(F.col("n").alias("u"), F.col("n_").alias("v")).distinct(), groups.where(F.col("texts") > MOST_AT_SHINGLE).select("n").distinct()


def _long_prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, 128 bits that tell the sequence of words, and the long fingerprint over distinct pairs of words."""
    names = [f"w{k}" for k in range(words)]

    def run(batches):
        memory = worker_memory().setdefault("words", Words())
        for b in batches:
            t1, t2, prints = [], [], []
            for text in b.column(1):
                own, hashes = memory.of(text.as_py())
                whole = xxhash.xxh3_128_digest(b" ".join(own))
                t1.append(int.from_bytes(whole[:8], "little", signed=True))
                t2.append(int.from_bytes(whole[8:], "little", signed=True))
                prints.append(long_fingerprint(word_runs(hashes, 2), words))
            table = np.stack(prints) if prints else np.zeros((0, words), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), *(pa.array(np.ascontiguousarray(table[:, k]), pa.int64()) for k in range(words))], ["doc_id", "row", "t1", "t2", *names])

    return _rows(docs).mapInArrow(run, "doc_id bigint, row bigint, t1 bigint, t2 bigint, " + ", ".join(f"{w} bigint" for w in names))


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """n and the sorted hashes of the distinct shingles of each text (n, text), cut to 32 bits as they travel twice a pair: of 300 shingles two meet once in 10^5 texts."""

    def run(batches):
        memory = worker_memory().setdefault("words", Words())
        for b in batches:
            sets = [np.unique((word_runs(memory.of(t.as_py())[1], width) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in b.column(1)]
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32)))], ["n", "set"])

    return texts.select("n", "text").mapInArrow(run, "n bigint, set array<int>")


def one_of_each(docs: DataFrame, width: int = 5, similar: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, nulls first.

    Texts are linked where their sets of ``width``-word shingles (A-Z lower-cased) have a Jaccard similarity of ``similar``
    or more; texts of the same words are one from the start, so are those without words. Candidates are texts whose
    fingerprints over distinct pairs of words meet at an anchor (see :class:`Plan`) and differ in few enough of 128
    other bits. Each is compared with the nearest and with the first that it meets, whose links settle most families.
    Then all texts of different components that share one of their least shingles are compared, and where these are
    too many to name them the members' rarest shingles name those that can be alike: no link is left out. Rows that
    repeat doc_id and text are one. All columns stay as they are, an empty table stays empty. What stays is named by a
    table of its own; all others are removed before this returns.
    """
    key, row = _shared.unused(docs, "key"), _shared.unused(docs, "row")
    rows = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)))
    with _shared.scratch(docs.sparkSession):
        stays, _ = _shared.written(_first_of_each(docs, rows, key, row, width, similar), "first", outlives=True)
    return rows.join(stays, [key, row], "left_semi").dropDuplicates([key, row]).drop(key, row)


def _first_of_each(docs: DataFrame, rows: DataFrame, key: str, row: str, width: int, similar: float) -> DataFrame:
    """The columns ``key`` and ``row`` of the texts that stay; ``rows`` are ``docs`` with both."""
    plan = Plan(docs.count(), similar)
    columns = [f"w{k}" for k in range(plan.words)]
    prints, _ = _shared.written(_long_prints(docs, plan.words), "fingerprints")
    texts = prints.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "row")).alias("first"), *(F.min(c).alias(c) for c in columns))
    texts, _ = _shared.written(texts.select(F.monotonically_increasing_id().alias("n"), "first", *columns), "texts")

    met = _met(texts, plan).groupBy("n").agg(F.min(F.struct("bits", "m")).alias("near"), F.min("m").alias("low"))
    pairs = met.select("n", F.explode(F.array("near.m", "low")).alias("m")).select(F.greatest("n", "m").alias("u"), F.least("n", "m").alias("v")).distinct()
    pairs, _ = _shared.written(pairs, "pairs")

    first = [F.coalesce("first.doc_id", F.lit(-1)).alias(key), F.col("first.row").alias(row)]

    def sets_of(wanted: DataFrame) -> DataFrame:
        held = rows.select(key, row, F.col("text").cast("string").alias("text")).join(wanted.join(texts, "n").select("n", *first).hint("shuffle_hash"), [key, row]).dropDuplicates([key, row])
        return _shared.written(_shingle_sets(held, width), "shingle-sets")[0]

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct()

    sets = sets_of(ends(pairs))
    found = _shared.components(_alike(pairs, sets, similar), "near-texts").withColumnRenamed("node", "n")
    label, _ = _shared.written(texts.select("n", "first").join(found, "n", "left").withColumn("component", F.coalesce("component", "n")), "near-components")
    left, crowded = _least_meetings(docs, label, width, similar)
    left, _ = _shared.written(left, "pairs")
    crowded, _ = _shared.written(crowded, "crowded")
    sets = sets.unionByName(sets_of(ends(left).unionByName(crowded).distinct().join(sets.select("n"), "n", "left_anti")))
    if not crowded.isEmpty():
        left = left.unionByName(_rare_meetings(sets.join(crowded, "n").join(label.select("n", "component"), "n"), similar)).distinct()
    named, label = label, label.select("n", "component")
    new = _alike(left, sets, similar).join(label.withColumnRenamed("n", "u").withColumnRenamed("component", "cu"), "u").join(label.withColumnRenamed("n", "v").withColumnRenamed("component", "cv"), "v")
    merged = _shared.components(new.select(F.col("cu").alias("u"), F.col("cv").alias("v")), "near-texts")
    named = named.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    return named.groupBy(F.coalesce("into", "component").alias("component")).agg(F.min("first").alias("first")).select(*first)


def op7_simhash_near_duplicates(spark, sf_dir):
    """doc_id, fingerprint and component_id of every document.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows are rows of one class; null
    doc_ids reach others but are nobody's component_id; an empty table gives no row.
    """
    found = near_duplicates(_shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
