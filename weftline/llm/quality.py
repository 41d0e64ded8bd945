"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies.

Each rule votes *good* (1), *bad* (-1) or abstains (0) on a document. The votes of all documents are counted by
pattern (at most 3^rules rows reach the driver, whatever the corpus holds), expectation-maximisation estimates each
rule's accuracy on either class and the share of good documents, and every document gets the posterior probability
that it is good, which decides in place of having to pass every rule.
The posterior is a sum of per-vote log odds, so it is applied as a column expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared

SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = ".,;:!?\"'()[]-\u00ab\u00bb\u201c\u201d\u2018\u2019\u2026\u00bf\u00a1\u2013\u2014"
WITHIN = str.maketrans("", "", "'-\u2019")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_ends bigint, n_distinct bigint, n_digits bigint, n_alpha bigint, n_plain bigint"


def repeated_words(ids: np.ndarray) -> int:
    """Words covered by a three-word window that occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    width = int(ids.max()) + 1
    if width < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * width + ids[1:-1], return_inverse=True)
        keys = pair.astype(np.int64) * width + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_ends, n_distinct, n_digits, n_alpha, n_plain of one text.

    ``bytes.split()`` splits on exactly x20 and x09-x0D. n_lines counts lines with a word, n_ends those that end in
    a sentence mark, n_alpha words with a letter, n_plain words of letters but for marks around and ``'`` or ``-`` within.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()
    vocab: dict[bytes, int] = {}
    ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int64, len(words))
    times = np.bincount(ids, minlength=1)
    forms = [w.decode() for w in vocab]
    alpha = [any(map(str.isalpha, w)) for w in forms]
    plain = [a and w.strip(MARKS).translate(WITHIN).isalpha() for a, w in zip(alpha, forms, strict=True)]
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    seen, dup, lines, ends = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            ends += bare[-1] in b".!?\"'"
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text) - spaces, len(SYMBOLS.findall(text)), dup, repeated_words(ids), lines, ends, len(vocab), len(raw) - len(raw.translate(None, b"0123456789")), *(int(times[: len(x)] @ np.array(x, np.int64)) if x else 0 for x in (alpha, plain))


def stats(docs: DataFrame) -> DataFrame:
    """The counts of :func:`text_stats` per document; null texts count as empty."""
    names = [x.split()[0] for x in STATS_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [text_stats(t.as_py()) for t in b.column(1)]
            columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STATS_SCHEMA)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, F.lit(-1)).when(self.good, F.lit(1)).otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules in the manner of published web-corpus filters, each on a trait of its own, as votes count as independent given the class.

    Ratios are per word, character or line; empty texts vote bad where they can.
    """
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    length = F.col("word_chars") / words
    dup = F.col("n_dup_lines") / lines
    repeats = F.col("n_repeat_words") / words
    distinct = F.col("n_distinct") / F.sqrt(words)
    ends = F.col("n_ends") / lines
    return [
        Rule("length", F.col("n_words") < 30, F.col("n_words") >= 50),
        Rule("word_length", (length < 3) | (length > 12), (length >= 3.5) & (length <= 10)),
        Rule("symbol_share", F.col("n_symbols") > 0.05 * F.col("word_chars"), F.col("n_symbols") < 0.02 * F.col("word_chars")),
        Rule("alphabetic", F.col("n_alpha") < 0.8 * F.col("n_words"), F.col("n_alpha") > 0.9 * F.col("n_words")),
        Rule("plain_words", F.col("n_plain") < 0.6 * F.col("n_words"), F.col("n_plain") > 0.8 * F.col("n_words")),
        Rule("digits", F.col("n_digits") > 0.2 * F.col("word_chars"), F.col("n_digits") < 0.1 * F.col("word_chars")),
        Rule("dup_lines", (dup > 0.3) & (F.col("n_dup_lines") > 2), dup < 0.1),
        Rule("repeats", repeats > 0.3, repeats < 0.15),
        Rule("diversity", distinct < 2, distinct > 4),
        Rule("line_ends", ends < 0.1, ends > 0.5),
    ]


#: Votes of a rule on good and on bad documents before any are seen: shares of -1, 0 and 1.
VOTES_IF_GOOD, VOTES_IF_BAD = (0.01, 0.09, 0.9), (0.4, 0.15, 0.45)


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 300, weight: float = 50.0) -> tuple[float, np.ndarray]:
    """Share of good documents and ``table[class, rule, vote + 1]``, by EM over counted vote patterns.

    Given the class (0 bad, 1 good) rules vote independently. Each rule has two accuracies, as a bad vote and a good
    vote need not be equally telling: how often it votes -1 on bad documents and 1 on good ones. ``VOTES_IF_GOOD``
    and ``VOTES_IF_BAD`` enter as Dirichlet priors worth ``weight`` documents of either class, which a larger corpus
    outweighs. They and the start, good unless some rule votes bad, say which class is which. Without documents the
    priors are returned.
    """
    prior = np.stack([np.tile(VOTES_IF_BAD, (n_rules, 1)), np.tile(VOTES_IF_GOOD, (n_rules, 1))])
    if not patterns:
        return 0.5, prior
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    good = np.array([0.98, 0.1, 0.02])[np.minimum((votes < 0).sum(1), 2)]
    table, share = prior, 0.5
    for _ in range(rounds):
        share = float(np.clip((good @ n + 9) / (n.sum() + 10), 0.02, 0.98))
        then = np.stack([np.einsum("p,prv->rv", n * w, one_hot) + weight * prior[c] for c, w in enumerate((1 - good, good))])
        then /= then.sum(2, keepdims=True)
        done = np.abs(then - table).max() < 1e-9
        table = then
        odds = math.log(share / (1 - share)) + np.einsum("prv,rv->p", one_hot, np.log(table[1] / table[0]))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if done:
            break
    return share, table


def judge(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, one vote per rule, ``posterior`` and ``kept``.

    One row per input row, so repeated rows stay repeated; a null text counts as empty and fails; columns other than
    doc_id and text are ignored. An empty table gives an empty result. Documents that fail the base rule are never
    kept; the others are kept where the posterior is at least ``threshold``.
    """
    rules = default_rules() if rules is None else rules
    counted, _ = _shared.written(stats(docs), "quality")
    voted = counted.select("*", base_failed().alias("base_failed"), *(r.vote().alias(f"vote_{r.name}") for r in rules))
    names = [f"vote_{r.name}" for r in rules]
    share, table = fit([(tuple(row[:-1]), row[-1]) for row in voted.groupBy(*names).count().collect()], len(rules))
    odds = F.lit(math.log(share / (1 - share)))
    for name, w in zip(names, np.log(table[1] / table[0]), strict=True):
        odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in w)), F.col(name) + 2)
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op9_quality_rules(spark, sf_dir):
    """doc_id, the base counts, base_failed, kept and the posterior of every document.

    Null and empty texts have no word and fail; repeated rows stay repeated and are judged alike; null doc_ids stay null;
    an empty table gives no row.
    """
    return judge(_shared.table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept", "posterior")
