"""Hidden Markov language model.

Words are symbols where they are frequent and classes by their last letters elsewhere; a word of a class is emitted by
the class and, within it, in proportion to its add-one count, whichever the state. Latent states are trained by
Baum-Welch: every task runs forward and backward over its texts, expected counts are summed across partitions, and the
driver holds bounded tables alone. A text's likelihood is the scaled forward recursion over its symbols, exact over
the whole text, plus the words' shares within their classes. Counts of rare words grow with the corpus and never leave
the executors: texts meet them in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared
from weftline.llm._worker import slices

CLASSES = 1024
HELD_OUT = (7, 2)
END = b""
FLUSH = 250_000


def words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z, cut at x20 and x09-x0D."""
    return (text or "").encode().lower().split()


def word_class(word: bytes) -> int:
    """By the last three letters; the end is like any word here."""
    return zlib.crc32(word.decode()[-3:].encode()) % CLASSES


def class_column(token: Column) -> Column:
    return F.crc32(F.encode(F.right(token, F.lit(3)), "UTF-8")) % CLASSES


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def token_counts(rows: DataFrame) -> DataFrame:
    """``token, c`` over the texts, the empty token being the end of each."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["token", "c"])

        for b in batches:
            for text in b.column(0):
                seen.update(words(text.as_py()))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return rows.select("text").mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Bounded: at most ``head`` words, the most frequent, with their counts; the first ``symbols`` of which are symbols of the model."""

    head: dict[bytes, tuple[int, int]]  # word: symbol, count
    symbols: int
    n: int
    v: int
    class_total: np.ndarray  # N + V + 1 of the words of each class that are no symbols

    @property
    def size(self) -> int:
        return self.symbols + CLASSES


def vocabulary(counts: DataFrame, head: int, symbols: int) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # A count's bucket is its order of magnitude, sixteen to each power of two: the buckets are few, whatever the corpus.
    bucket = F.floor(F.log2("c") * 16).cast("int")
    room, least = head, 1 << 30
    for k, m in sorted(((r[0], r[1]) for r in counts.groupBy(bucket.alias("k")).count().collect()), reverse=True):
        if m > room:
            break
        room, least = room - m, k
    top = sorted(((r[0].encode(), r[1]) for r in counts.where(bucket >= least).collect()), key=lambda x: (-x[1], x[0]))
    by_class = np.ones(CLASSES)
    for k, c, m in counts.groupBy(class_column(F.col("token")).cast("int").alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        by_class[k] += c + m
    own = min(symbols, len(top))
    for w, c in top[:own]:
        by_class[word_class(w)] -= c + 1
    table = {w: (i if i < own else own + word_class(w), c) for i, (w, c) in enumerate(top)}
    return Vocabulary(table, own, n, v, by_class)


ENCODED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known_log double, class_log double, symbols binary, tail array<struct<token: string, n: bigint>>"


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text as symbols, with the parts of its scores that the bounded vocabulary settles and its other words' counts."""
    shared = _shared.Shared(rows.sparkSession, vocab)

    def run(batches):
        own = shared.value
        log_class = np.log10(own.class_total)
        log_count = {w: (s, float(np.log10(c + 1)), s >= own.symbols) for w, (s, c) in own.head.items()}
        for b in (part for whole in batches for part in slices(whole, 3)):
            columns: list[list] = [[] for _ in range(5)]
            tokens, counts, cuts = [], [], [0]
            for text in b.column(3):
                ws = words(text.as_py())
                ws.append(END)
                tally = Counter(ws)
                known, known_log, class_log, where = 0, 0.0, 0.0, {}
                for w, n in tally.items():
                    if (hit := log_count.get(w)) is not None:
                        known += n
                        known_log += n * hit[1]
                        where[w] = hit[0]
                        if hit[2]:
                            class_log += n * (hit[1] - log_class[hit[0] - own.symbols])
                    else:
                        k = word_class(w)
                        class_log -= n * log_class[k]
                        where[w] = own.symbols + k
                        tokens.append(w)
                        counts.append(n)
                cuts.append(len(tokens))
                symbols = np.fromiter(map(where.__getitem__, ws), "<u2", len(ws)).tobytes()
                for column, x in zip(columns, (len(ws), known, known_log, float(class_log), symbols), strict=True):
                    column.append(x)
            tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["token", "n"]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), tail], ["row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "class_log", "symbols", "tail"])

    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(run, ENCODED)


@dataclass
class Model:
    start: np.ndarray  # of texts
    middle: np.ndarray  # of windows within texts
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def first_model(weights: np.ndarray, states: int, seed: int = 7) -> Model:
    """States that stay, each with its own bent away from the symbols' shares: texts in one manner pull one state."""
    rng = np.random.default_rng(seed)
    emit = (weights / weights.sum())[:, None] * rng.gamma(1.0, 1.0, (len(weights), states)) + 1e-12
    even = np.full(states, 1 / states)
    return Model(even, even, 0.1 / states + 0.9 * np.eye(states), emit / emit.sum(0))


def ordered(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences end to end with their starts, longest first, how many last beyond each step, and their order."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), "right")
    return np.concatenate(sequences).astype(np.int64), starts[order], alive, order


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence: the forward recursion, scaled at every step. No sequence may be empty."""
    flat, starts, alive, order = ordered(sequences)
    total = np.zeros(len(sequences))
    alpha = np.tile(model.start, (len(sequences), 1))
    for t, n in enumerate(alive):
        alpha = alpha[:n] if t == 0 else alpha[:n] @ model.move
        alpha = alpha * model.emit[flat[starts[:n] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty_like(total)
    out[order] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], is_start: np.ndarray, into: dict[str, np.ndarray]) -> None:
    """Adds the sequences' expected counts under the model to ``into``: forward, then backward over kept forwards."""
    flat, starts, alive, order = ordered(sequences)
    k = len(model.start)
    first = is_start[order]
    kept = np.empty((len(flat), k))
    scales = np.empty(len(flat))
    alpha = np.where(first[:, None], model.start, model.middle)
    for t, n in enumerate(alive):
        at = starts[:n] + t
        alpha = alpha[:n] if t == 0 else alpha[:n] @ model.move
        alpha = alpha * model.emit[flat[at]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        kept[at], scales[at] = alpha, scale
    beta = np.ones((len(starts), k))
    moved = np.zeros((k, k))
    for t in range(len(alive) - 1, 0, -1):
        n = alive[t]
        at = starts[:n] + t
        ahead = model.emit[flat[at]] * beta[:n] / scales[at][:, None]
        before = kept[at - 1]
        moved += before.T @ ahead
        kept[at] *= beta[:n]
        beta[:n] = ahead @ model.move.T
    kept[starts] *= beta
    kept /= kept.sum(1, keepdims=True)
    into["move"] += moved * model.move
    into["start"] += kept[starts][first].sum(0)
    into["middle"] += kept.sum(0)
    for s in range(k):
        into["emit"][:, s] += np.bincount(flat, kept[:, s], len(into["emit"]))


def baum_welch(encoded: DataFrame, weights: np.ndarray, states: int, rounds: int, window: int = 1024, at_once: int = 400_000) -> Model:
    """Trains on all encoded texts that aren't held out.

    For training alone, texts are cut into windows of ``window`` tokens, of which all but a text's first begin in the
    states' overall shares. Tasks keep at most ``at_once`` tokens and a window's worth of forward values at a time.
    """
    spark = encoded.sparkSession
    model, size = first_model(weights, states), len(weights)
    texts = encoded.where(~F.col("held_out")).select("symbols")
    share = weights / weights.sum()
    for _ in range(rounds):
        shared = _shared.Shared(spark, model)

        def run(batches, shared=shared):
            own = shared.value
            into = {"start": np.zeros(states), "middle": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((size, states))}
            held, starts, n = [], [], 0
            for b in batches:
                for x in b.column(0):
                    ids = np.frombuffer(x.as_buffer(), "<u2")
                    for at in range(0, len(ids), window):
                        held.append(ids[at : at + window])
                        starts.append(at == 0)
                        n += len(held[-1])
                        if n >= at_once:
                            expected_counts(own, held, np.array(starts), into)
                            held, starts, n = [], [], 0
            if held:
                expected_counts(own, held, np.array(starts), into)
            seen = np.flatnonzero(into["emit"].any(1))
            keys = np.concatenate([seen, size + np.arange(states + 2)])
            values = np.concatenate([into["emit"][seen], into["move"], into["start"][None], into["middle"][None]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(values[:, s]) for s in range(states))], ["key", *(f"s{s}" for s in range(states))])

        sums = texts.mapInArrow(run, "key int, " + ", ".join(f"s{s} double" for s in range(states))).groupBy("key").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states)))
        table = np.zeros((size + states + 2, states))
        for row in sums.collect():
            table[row[0]] = row[1:]
        emit = table[:size] + share[:, None] * (10 + 0.001 * table[:size].sum(0)) + 1e-12
        move = table[size : size + states] + 0.1
        start, middle = table[size + states] + 0.1, table[size + states + 1] + 0.1
        model = Model(start / start.sum(), middle / middle.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def score_corpus(docs: DataFrame, states: int = 8, rounds: int = 3, head: int = 60_000, symbols: int = 8192) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Learns from rows whose crc32 of doc_id modulo 7 is not 2 (rows with a null doc_id are learned from). Null texts
    count as empty: their one token is the end. Repeated rows count and are scored as often as they come; columns
    other than doc_id and text are ignored. Without any text to learn from, all tokens are unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    counts, _ = _shared.written(token_counts(rows.where(~F.col("held_out"))), "tokens")
    vocab = vocabulary(counts, head, min(symbols, 65_535 - CLASSES))
    encoded, _ = _shared.written(encode(rows.withColumn("row", F.monotonically_increasing_id()), vocab), "encoded")
    weights = np.concatenate([np.zeros(vocab.symbols), np.maximum(vocab.class_total, 1.0)])
    for s, c in vocab.head.values():
        if s < vocab.symbols:
            weights[s] = c
    shared = _shared.Shared(spark, baum_welch(encoded, weights, states, rounds))

    def run(batches):
        model = shared.value
        for b in batches:
            found = log_likelihoods(model, [np.frombuffer(x.as_buffer(), "<u2") for x in b.column(1)]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found / np.log(10))], ["row", "path_log"])

    paths = encoded.select("row", "symbols").mapInArrow(run, "row bigint, path_log double")
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", F.col("t.token").alias("token"), F.col("t.n").alias("n"))
    # Words that no training text holds add log10(0 + 1) = 0 to either score, so only those that are found go on.
    found = tail.join(counts, "token").select("row", "n", (F.col("n") * F.log10(F.col("c") + 1)).alias("x"))
    by_row = found.groupBy("row").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "class_log").join(paths, "row").join(by_row, "row", "left")
    rest, mass = F.coalesce("x", F.lit(0.0)), float(np.log10(vocab.n + vocab.v + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("bigint").alias("train_tokens"),
        (F.col("known_log") + rest - F.col("n_tokens") * F.lit(mass)).alias("base_score"),
        (F.col("path_log") + F.col("class_log") + rest).alias("score"),
    )


def op2_hmm_language_model(spark, sf_dir):
    return score_corpus(_shared.table(spark, sf_dir, "documents"))
