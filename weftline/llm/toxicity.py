"""Toxic passages as maximum-scoring segments of token log odds.

Token log odds come from labelled documents: the numbers of toxic and of other texts that hold a token, near-copies
counted once, smoothed by a Dirichlet prior in proportion to the token's share of all. Each is drawn towards zero by so
many of its deviations, so that a token weighs, for or against, as far as the texts that hold it vouch for it. Words
that no text vouches for fall back on their longest telling prefix. Every token also costs a constant. One linear scan
finds all maximal scoring segments of a text; extreme-value statistics of segments in clean documents turn a segment's
score and the text's length into the number of such segments to expect by chance, and a logistic curve turns that into
a score. Statistics, curve and the number of deviations are fitted on texts that had no part in the weights that score
them: each third of the labelled texts is measured with weights from the others.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared

MASK_TO_SPACE = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))
PREFIXES = (7, 6, 5, 4)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(MASK_TO_SPACE).split()


def features(word: bytes) -> list[bytes]:
    """The word, then its prefixes from the longest, each marked as one."""
    text = word.decode()
    return [word, *(b"^" + text[:k].encode() for k in PREFIXES if len(text) > k)]


def _scan(places: np.ndarray, gains: np.ndarray, before: np.ndarray) -> list[tuple[float, int, int]]:
    """Maximal segments from the places of positive scores, these, and the sums of all scores before them (Ruzzo and Tompa)."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    for place, gain, low in zip(places.tolist(), gains.tolist(), before.tolist(), strict=True):
        high, first, end = low + gain, place, place + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j -= 1
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, end))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(high - low, first, end) for low, high, first, end in found]


def maximal_segments(at: np.ndarray, weight: np.ndarray, cost: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first token, end), in order of place.

    ``at`` holds the places of the tokens with a positive ``weight``; each other token costs ``cost``.
    """
    before = np.cumsum(weight) - weight - cost * (at - np.arange(len(at)))
    return _scan(at, weight, before)


def scored_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a text's token scores, of either sign."""
    at = np.flatnonzero(scores > 0)
    return _scan(at, scores[at], np.cumsum(scores)[at] - scores[at]) if len(at) else []


@dataclass
class Model:
    """Weights of telling features, the cost of any token, the null's extreme-value parameters, the calibration."""

    weights: dict[bytes, float] = field(default_factory=dict)
    cost: float = 0.5
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float] = (-3.0, 0.0)
    significant: float = 0.05

    def weight(self, word: bytes) -> float:
        """Of the word where it tells, else of its longest telling prefix, else 0."""
        for f in features(word):
            if (w := self.weights.get(f)) is not None:
                return w
        return 0.0

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score to expect in a clean text of n tokens."""
        return self.scale * max(n, 1) * math.exp(-self.rate * score)

    def segments(self, words: list[bytes], memo: _Memo) -> list[tuple[float, int, int]]:
        if not self.weights:
            return []
        return scored_segments(np.fromiter(map(memo.__getitem__, words), np.float64, len(words)) - self.cost)

    def surprise(self, segments: list[tuple[float, int, int]], n: int) -> float:
        """Minus log10 of the chance that a clean text holds segments like the significant ones (the best, if none is)."""
        if not segments:
            return 0.0
        chances = sorted(self.expected(s, n) for s, _, _ in segments)
        own = [c for c in chances if c < self.significant] or chances[:1]
        return min(50.0, sum(max(0.0, -math.log10(-math.expm1(-c) if c > 1e-12 else max(c, 1e-300))) for c in own))

    def score(self, surprise: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * surprise))))


class _Memo(dict):
    def __init__(self, model: Model, most: int = 500_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word):
        w = self.model.weight(word)
        if len(self) < self.most:
            self[word] = w
        return w


def learn_weights(counts: list[tuple[bytes, int, int]], n_toxic: int, n_other: int, clear: float = 2.0, share: float = 0.015) -> dict[bytes, float]:
    """Log odds of features (toxic count, other count), ``clear`` deviations nearer to zero; without those that reach it.

    The Dirichlet prior adds one text to each feature, and ``share`` of those that hold it, split between the classes
    as all words are (``n_toxic`` and ``n_other``).
    """
    total, out = n_toxic + n_other, {}
    if not n_toxic or not n_other:
        return out
    for f, t, o in counts:
        more = (1 + share * (t + o)) / total
        t, o = t + more * n_toxic, o + more * n_other
        odds = math.log(t / n_toxic) - math.log(o / n_other)
        left = abs(odds) - clear * math.sqrt(1 / t + 1 / o)
        if left > 0:
            out[f] = math.copysign(min(left, 12.0), odds)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Logistic regression of 0/1 labels on one number that occurs ``n`` times, with a small ridge; classes weigh alike."""
    a, b = -2.0, 1.0
    w = n * np.where(y > 0, 0.5 / max(1, n[y > 0].sum()), 0.5 / max(1, n[y == 0].sum())) * n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -60, 60)))
        g = np.array([(w * (y - p)).sum() - 0.01 * a, (w * (y - p) * x).sum() - 0.01 * b])
        h = w * p * (1 - p)
        m = np.array([[h.sum() + 0.01, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.01]])
        step = np.linalg.solve(m, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


FOLDS = 3
#: Numbers of deviations to choose from.
CLEAR = (2.0, 3.0, 4.0)


def family_keys(words: list[bytes], width: int = 3) -> tuple[int, ...]:
    """Three min-hashes of a text's runs of ``width`` words: near-copies share most of them."""
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[k : k + width])) for k in range(max(1, len(words) - width + 1))}
    own = np.fromiter(hashes, np.uint64, len(hashes))
    return tuple(int(((own ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1)) for salt in (0, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93))


def labelled(docs: DataFrame, labels: DataFrame, most_labelled: int, held_out: tuple[int, int] | None) -> DataFrame:
    """``text, toxic, fold, f0, f1, f2`` of the documents to learn from."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if held_out:
        rows = rows.where(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % held_out[0] != held_out[1])
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    half = most_labelled // 2
    rows = rows.withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    parts = []
    for toxic, n in sorted((r[0], r[1]) for r in rows.groupBy("toxic").count().collect()):
        # What hashes beyond twice the share that is wanted can't be among the least: few rows are left to order.
        own = rows.where((F.col("toxic") == toxic) & (F.col("order") < (1 << 40) * min(1.0, 2.0 * half / n)))
        parts.append(own.orderBy("order", "doc_id").limit(half).select("doc_id", "toxic"))
    chosen = parts[0] if parts else rows.select("doc_id", "toxic")
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    chosen, _ = _shared.written(chosen, "labelled")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most most_labelled rows of two numbers: a bounded side.
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int").alias("fold"))

    def keyed(batches):
        for b in batches:
            keys = [family_keys(tokens(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in range(3))], ["text", "toxic", "fold", "f0", "f1", "f2"])

    return _shared.written(sample.mapInArrow(keyed, "text string, toxic int, fold int, f0 bigint, f1 bigint, f2 bigint"), "labelled-texts")[0]


def feature_counts(sample: DataFrame) -> tuple[list[tuple[bytes, list[int], list[int]]], list[int], list[int]]:
    """Toxic and other texts by fold for each feature, and the folds' sums over all words; families of near-copies count once.

    Only features that differ by a deviation at least come to the driver: others weigh nothing whatever the fold.
    """

    def count(batches):
        for b in batches:
            by: dict[tuple[bytes, int], list[int]] = {}
            for text, toxic, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = set(tokens(text.as_py()))
                for f in {f for w in words for f in features(w)}:
                    by.setdefault((f, fold), [0, 0])[toxic] += 1
                by.setdefault((b"", fold), [0, 0])[toxic] += len(words)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in by], pa.binary()), pa.array([k[1] for k in by], pa.int32()), pa.array([v[1] for v in by.values()], pa.int64()), pa.array([v[0] for v in by.values()], pa.int64())], ["feature", "fold", "toxic", "other"])

    for key in ("f0", "f1", "f2"):
        sample = sample.dropDuplicates([key, "toxic"])
    counted = sample.select("text", "toxic", "fold").mapInArrow(count, "feature binary, fold int, toxic bigint, other bigint")
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("toxic", "other") for k in range(FOLDS)]
    counts, _ = _shared.written(counted.groupBy("feature").agg(*by_fold, F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "features")
    all_words = counts.where(F.col("feature") == b"").first()
    if all_words is None:
        return [], [0] * FOLDS, [0] * FOLDS
    t, o = F.col("toxic") + 0.5, F.col("other") + 0.5
    clear = F.abs(F.log(t / max(1, all_words["toxic"])) - F.log(o / max(1, all_words["other"]))) > F.sqrt(1 / t + 1 / o)
    rows = counts.where((F.col("feature") != b"") & (F.col("toxic") + F.col("other") > 2) & clear).collect()
    parts = lambda r, c: [r[f"{c}{k}"] for k in range(FOLDS)]
    return sorted((bytes(r["feature"]), parts(r, "toxic"), parts(r, "other")) for r in rows), parts(all_words, "toxic"), parts(all_words, "other")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 40_000, held_out: tuple[int, int] | None = (3, 1)) -> Model:
    """The model, from labelled documents alone.

    ``labels`` has doc_id and toxic (rows of a doc_id with several labels count as toxic if one is; null labels don't
    count). Rows whose crc32 of doc_id is ``held_out[1]`` modulo ``held_out[0]`` are never looked at. The classifier
    is fitted on at most ``most_labelled`` documents, those with the least hash of their doc_id, half of them toxic
    where there are enough. Without labels of both kinds every text gets the same low score. Copies of a text are in
    one fold, so that no text is measured with weights that it has set itself.
    """
    sample = labelled(docs, labels, most_labelled, held_out)
    counts, toxic, other = feature_counts(sample)

    def learned(clear: float, without: int | None = None) -> Model:
        some = [k for k in range(FOLDS) if k != without]
        own = [(f, sum(t[k] for k in some), sum(o[k] for k in some)) for f, t, o in counts]
        return Model(learn_weights(own, sum(toxic[k] for k in some), sum(other[k] for k in some), clear))

    if not learned(CLEAR[0]).weights:
        return Model()
    shared = _shared.Shared(docs.sparkSession, [[learned(clear, k) for k in range(FOLDS)] for clear in CLEAR])

    def measure(batches):
        own = shared.value
        memos = [[_Memo(m) for m in some] for some in own]
        for b in batches:
            out = []
            for text, label, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = tokens(text.as_py())
                out += [(k, label, len(words), [s for s, _, _ in some[fold].segments(words, memos[k][fold])]) for k, some in enumerate(own)]
            k, t, n, s = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(t, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], ["k", "toxic", "n", "scores"])

    measured = sample.select("text", "toxic", "fold").mapInArrow(measure, "k int, toxic int, n bigint, scores array<double>")
    measured, _ = _shared.written(measured, "measured")
    best = None
    for k, clear in enumerate(CLEAR):
        rows = measured.where(F.col("k") == k)
        model = learned(clear)
        model.rate, model.scale = extreme_value(rows.where("toxic = 0"))
        n, x, y = _surprises(rows, model)
        model.curve = fit_curve(x, y, n)
        loss = _loss(model, x, y, n)
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def _surprises(rows: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """Distinct surprises, to two digits, of toxic and other texts and how many there are of each: at most some thousand rows."""

    def run(batches):
        for b in batches:
            x = [round(model.surprise([(s, 0, 0) for s in scores], n), 2) for n, scores in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64())], ["toxic", "x"])

    got = rows.select("toxic", "n", "scores").mapInArrow(run, "toxic int, x double").groupBy("toxic", "x").count().collect()
    got = sorted((r["toxic"], r["x"], r["count"]) for r in got)
    y, x, n = (np.array(c, float) for c in zip(*got, strict=True))
    return n, x, y


def _loss(model: Model, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Mean log loss, both classes weighing alike."""
    p = np.clip(np.array([model.score(v) for v in x]), 1e-12, 1 - 1e-12)
    each = -np.log(np.where(y > 0, p, 1 - p)) * n
    return sum(float(each[y == c].sum()) / max(1.0, float(n[y == c].sum())) for c in (0, 1))


def extreme_value(clean: DataFrame) -> tuple[float, float]:
    """Rate and scale of clean segments: a clean text of n tokens holds scale * n * exp(-rate * s) of at least score s.

    Fitted to the tenth of the clean segments (columns n, scores by text) with the greatest scores: the rate is the
    inverse mean excess over the least of these with one pseudo-segment of mean 1, the scale their number per token with
    half a segment added, so that clean texts without any still give a finite scale. Scores are counted to two digits.
    """
    n_tokens = clean.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = clean.select(F.explode("scores").alias("s")).select(F.round("s", 2).alias("s")).groupBy("s").count().orderBy("s").collect()
    s, m = (np.array([r[k] for r in got], float) for k in (0, 1))
    above = np.cumsum(m) >= 0.9 * m.sum()
    least = float(s[above][0]) if len(s) else 0.0
    found, excess = float(m[above].sum()), float((m * (s - least))[above].sum())
    rate = min((found + 1) / (excess + 1.0), 2.0)
    return rate, (found + 0.5) / (n_tokens + 1) * math.exp(rate * least)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_tokens, n_passages, passages`` per row; passages: struct of start, end, score, expected.

    Null and empty texts have no passage and the calibration's lowest score; repeated rows are scored alike; columns
    other than doc_id and text are ignored.
    """
    shared = _shared.Shared(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        own = shared.value
        memo = _Memo(own)
        for b in batches:
            scores, sizes, passages = [], [], []
            for text in b.column(1):
                words = tokens(text.as_py())
                found = own.segments(words, memo)
                scores.append(own.score(own.surprise(found, len(words))))
                sizes.append(len(words))
                passages.append([{"start": f, "end": e, "score": s, "expected": x} for s, f, e in found if (x := own.expected(s, len(words))) < own.significant])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array([len(p) for p in passages], pa.int64()), pa.array(passages, kind)], ["doc_id", "score", "n_tokens", "n_passages", "passages"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, n_tokens bigint, n_passages bigint, passages array<struct<start: bigint, end: bigint, score: double, expected: double>>")


THRESHOLD = 0.7


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay as they are, null texts too."""
    shared, at = _shared.Shared(docs.sparkSession, model), docs.columns.index("text")

    def run(batches):
        own = shared.value
        memo = _Memo(own)
        for b in batches:
            sized = ((words, own.segments(words, memo)) for words in (tokens(t.as_py()) for t in b.column(at)))
            yield b.filter(pa.array([own.score(own.surprise(found, len(words))) < threshold for words, found in sized], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity_segments(spark, sf_dir):
    """doc_id, held_out, score, predicted and the number of significant passages of every document.

    Null and empty texts have no passage and the lowest score; repeated rows are scored alike; a null doc_id isn't held
    out (and has no label); an empty table gives no row.
    """
    docs = _shared.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, _shared.table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages")
