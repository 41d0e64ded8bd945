"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens: tokens at its ones are hashed, those at its zeros may differ. The seed
hashes of documents are joined with those of benchmark items; equal ones fix an alignment, which is then compared token
by token: the best scoring stretch (a match +1, a mismatch -2), and those on either side of it, count where they are
long enough, substitutions included. Stretches of one item add up by the item's positions that they match, so insertions
and longer substitutions split a passage only. Short items are cut into one part more than they may have substitutions,
of which one stands in the document as it is: the parts are their seeds. What many items have in common, such as the
wording of a question, tells nothing about one of them: something of the rest must match too.

Before the join documents' hashes pass two bitmaps, of the benchmark's tokens and of its seeds, whose size is bounded;
what they let through in error the join drops.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared
from weftline.llm._worker import worker_memory

#: Weight 7 over spans of 7, 10, 11 and 12 tokens.
MASKS = ("1111111", "1101011011", "11100110101", "110010101011")
MASK_TO_SPACE = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))
SCHEMA = "doc_id bigint, item_id bigint, item_words bigint, matched bigint, substituted bigint, doc_start bigint, doc_end bigint"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: A stretch of seven words that more items than this have is common, and a document must match as many words beyond such.
COMMON, BEYOND = 10, 7


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(MASK_TO_SPACE).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seed_hashes(ids: np.ndarray, mask: str, at: np.ndarray) -> np.ndarray:
    h = np.full(len(at), len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = mix(h + ids[at + k].astype(np.uint64) + np.uint64(1))
    return h


def usable(known: np.ndarray, mask: str) -> np.ndarray:
    """Positions at which all the tokens that the mask selects are known."""
    n = len(known) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for k, bit in enumerate(mask):
        if bit == "1":
            ok &= known[k : k + n]
    return np.flatnonzero(ok)


def best_stretch(same: np.ndarray, penalty: int = 2) -> tuple[int, int]:
    """Half-open bounds of the maximum-scoring stretch of a boolean alignment; the first of equals."""
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -penalty))))
    gain = sums - np.minimum.accumulate(sums)
    end = int(gain.argmax())
    return int(sums[: end + 1].argmin()) if end else 0, end


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Bounds of the best stretch and of those on either side of it in turn, with at least ``least`` matches each."""
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if same[lo:hi].sum() >= least:
            a, b = best_stretch(same[lo:hi])
            if same[lo + a : lo + b].sum() >= least:
                out.append((lo + a, lo + b))
            todo += [(lo, lo + a), (lo + b, hi)]
    return out


def wanted(n: int, min_words: int) -> int:
    """Matches that an item of ``n`` words needs: four fifths of it, at most ``min_words``."""
    return min(min_words, -(-4 * n // 5))


class Index:
    """Benchmark items by their seed hashes. Size: proportional to the benchmark alone."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS, min_words: int = 13):
        self.masks, self.min_words = masks, min_words
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            if item_id is not None and (words := tokens(text)):
                self.items.append((item_id, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64)))
        self.seeds = []
        for mask in masks:
            hashes, where = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
            for k, (_, ids) in enumerate(self.items):
                at = usable(np.ones(len(ids), bool), mask)
                hashes.append(seed_hashes(ids, mask, at))
                where.append(np.stack([np.full(len(at), k), at], 1))
            h, w = np.concatenate(hashes), np.concatenate(where)
            order = np.argsort(h, kind="stable")
            self.seeds.append((mask, h[order], w[order]))
        parts = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            if self.short(len(ids)):
                n = len(ids) - wanted(len(ids), min_words) + 1
                parts[len(ids) // n] += [(k, i * (len(ids) // n)) for i in range(n)]
        for width, where in parts.items():
            h = np.concatenate([seed_hashes(self.items[k][1], "1" * width, np.array([at])) for k, at in where])
            order = np.argsort(h, kind="stable")
            self.seeds.append(("1" * width, h[order], np.array(where, np.int64)[order]))

    @staticmethod
    def short(n: int) -> bool:
        """Too few words for the masks to meet whatever the substitutions."""
        return 7 <= n < 16

    def alignments(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """Item numbers with the document position of the item's first token, of all seed hits."""
        found: set[tuple[int, int]] = set()
        known = ids >= 0
        for mask, h, where in self.seeds:
            at = usable(known, mask)
            if not len(at) or not len(h):
                continue
            mine = seed_hashes(ids, mask, at)
            left, right = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            for i in np.flatnonzero(right > left):
                found.update((int(k), int(at[i] - p)) for k, p in where[left[i] : right[i]])
        return found

    def overlaps(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        """Rows of item_id, item_words, matched, substituted, doc_start, doc_end, by item."""
        by: dict[int, list[int]] = defaultdict(list)
        for k, start in self.alignments(ids):
            by[k].append(start)
        found = ((self.items[k][0], overlap(ids, self.items[k][1], starts, self.min_words)) for k, starts in by.items())
        return sorted((item_id, *x) for item_id, x in found if x is not None)


def overlap(ids: np.ndarray, item: np.ndarray, starts: list[int], min_words: int, common: np.ndarray | None = None) -> tuple[int, ...] | None:
    """item_words, matched, substituted, doc_start, doc_end of an item in a document, aligned at ``starts``; None where too little matches.

    ``common`` are the item's positions that many items have in common. Where seven or more are left, as many of these
    (four fifths, where that is less) must match too.
    """
    n = len(item)
    hit, over, low, high = np.zeros(n, bool), np.zeros(n, bool), len(ids), 0
    for start in starts:
        lo, hi = max(0, -start), min(n, len(ids) - start)
        same = ids[start + lo : start + hi] == item[lo:hi]
        found = stretches(same, min(7, n))
        if Index.short(n) and same.sum() >= wanted(n, min_words):
            at = np.flatnonzero(same)
            found = [(int(at[0]), int(at[-1]) + 1)]
        for a, b in found:
            hit[lo + a : lo + b] |= same[a:b]
            over[lo + a : lo + b] = True
            low, high = min(low, start + lo + a), max(high, start + lo + b)
    matched = int(hit.sum())
    if not over.any() or matched < wanted(n, min_words):
        return None
    if common is not None:
        own = n - int(common.sum())
        if own >= BEYOND and int((hit & ~common).sum()) < wanted(own, BEYOND):
            return None
    return n, matched, int(over.sum()) - matched, low, high


class TokenHashes(dict):
    """64-bit hashes of tokens, kept for those met last."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = (xxhash.xxh64_intdigest(token) ^ 1 << 63) - (1 << 63)  # signed, as numpy takes these faster
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def item_seeds(ids: np.ndarray, masks: tuple[str, ...], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of an item's seeds, those of the masks and, of a short item, its parts."""
    n = len(ids)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for mask in masks:
        at = np.arange(max(0, n - len(mask) + 1))
        hashes.append(seed_hashes(ids, mask, at))
        places.append(at)
    if Index.short(n):
        parts = n - wanted(n, min_words) + 1
        at = np.arange(parts) * (n // parts)
        hashes.append(seed_hashes(ids, "1" * (n // parts), at))
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def _benchmark(benchmark: DataFrame, masks: tuple[str, ...], min_words: int) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """Items (k, item_id, text, common places), their seeds (h, k, p), their distinct token hashes (h) and the widths of short ones' parts."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items, _ = _shared.written(items.select(F.monotonically_increasing_id().alias("k"), "item_id", "text"), "items")

    def seeds(batches):
        hashes = TokenHashes()
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = hashes.of(text.as_py())
                h, p = item_seeds(ids, masks, min_words)
                plain = np.arange(max(0, len(ids) - 6))
                kinds = [(h, p, 0), (seed_hashes(ids, "1" * 7, plain), plain, 1), (np.unique(ids), np.zeros(len(np.unique(ids)), np.int64), 2)]
                if Index.short(n := len(ids)):
                    kinds.append((np.array([n // (n - wanted(n, min_words) + 1)], np.uint64), np.zeros(1, np.int64), 3))
                for own, at, kind in kinds:
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), k, np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(len(own), kind, np.int8))], ["h", "k", "p", "kind"])

    found, _ = _shared.written(items.select("k", "text").mapInArrow(seeds, "h bigint, k bigint, p int, kind tinyint"), "item-seeds")
    sevens = found.where("kind = 1")
    often = sevens.groupBy("h").agg(F.count_distinct("k").alias("n")).where(F.col("n") > COMMON).select("h")
    common = sevens.join(often, "h").groupBy("k").agg(F.collect_set("p").alias("common"))
    return items.join(common, "k", "left"), found.where("kind = 0").select("h", "k", "p"), found.where("kind = 2").select("h").distinct(), sorted(r[0] for r in found.where("kind = 3").select("h").distinct().collect())


def _bitmap(hashes: DataFrame, most_bytes: int) -> np.ndarray:
    """Bits at the hashes' low digits, 64 times as many as there are hashes or more, but not more than ``most_bytes`` hold."""
    most = max(6, (8 * most_bytes).bit_length() - 1)
    bits = min(most, max(6, (64 * hashes.count()).bit_length()))
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per pair of document and benchmark item that share a passage (columns of ``SCHEMA``).

    A pair is reported where at least ``min_words`` of the item's words (four fifths, where that is less) lie in verified
    stretches of at least seven matches, or, of an item of 7 to 15 words, match anywhere in one alignment; and where at
    least seven of them (four fifths, where that is less) are beyond what over ``COMMON`` items have in common, unless
    that leaves less than seven words of the item. Items of fewer than seven words are never seeded and so never reported.
    Texts are read whole; null texts hold no words; rows with a null item_id are ignored; repeated rows give
    repeated pairs per document row and one per item row. Other columns are ignored; empty tables give no pair.

    Documents are read twice: for their seeds, and once more those that share one. What is broadcast of the benchmark
    are two bitmaps of at most ``block_bytes`` together; its seeds, items and alignments meet the documents' in joins.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    items, seeds, words, widths = _benchmark(benchmark, masks, min_words)
    every = (*masks, *("1" * w for w in widths))
    shared = _shared.Shared(spark, (_bitmap(words, block_bytes // 2), _bitmap(seeds.select("h").distinct(), block_bytes // 2)))

    def find(batches):
        known, seeded = shared.value
        hashes = worker_memory().setdefault("tokens", TokenHashes())
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = hashes.of(text.as_py())
                ok = in_bitmap(known, ids)
                for mask in every:
                    at = usable(ok, mask)
                    if len(at):
                        h = seed_hashes(ids, mask, at)
                        hit = np.flatnonzero(in_bitmap(seeded, h))
                        for column, x in zip(out, (np.full(len(hit), row), h[hit].view(np.int64), at[hit].astype(np.int32)), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, t), k) for x, t, k in zip(out, (np.int64, np.int64, np.int32), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["row", "h", "at"])

    hits, _ = _shared.written(rows.select("row", "text").mapInArrow(find, "row bigint, h bigint, at int"), "seed-hits")
    starts = hits.join(seeds, "h").groupBy("row", "k").agg(F.collect_set(F.col("at") - F.col("p")).alias("starts"))
    per_row = starts.join(items, "k").groupBy("row").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item"), "common", "starts")).alias("places"))
    places, _ = _shared.written(per_row, "alignments")

    def verify(batches):
        hashes = worker_memory().setdefault("tokens", TokenHashes())
        for b in batches:
            found = []
            for doc_id, text, some in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                ids = hashes.of(text.as_py())
                for x in some.as_py():
                    item = hashes.of(x["item"])
                    common = None
                    if x["common"]:
                        common = np.zeros(len(item), bool)
                        for p in x["common"]:
                            common[p : p + 7] = True
                    if (got := overlap(ids, item, sorted(x["starts"]), min_words, common)) is not None:
                        found.append((doc_id, x["item_id"], *got))
            columns = list(zip(*sorted(found, key=str), strict=True)) or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

    return rows.join(places, "row").select("doc_id", "text", "places").mapInArrow(verify, SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the rows that share a passage with any benchmark item; all columns stay as they are, whatever their names.

    Rows that repeat a contaminated doc_id and text go with it; null texts stay.
    """
    row, gone = _shared.unused(docs, "row_of"), _shared.unused(docs, "row_gone")
    keyed = _rows(docs).select("row", "doc_id", "text")
    # Null doc_ids are told apart by the row's hash.
    found = contaminated(keyed.select(F.col("row").alias("doc_id"), "text"), benchmark, masks, min_words, block_bytes)
    found, _ = _shared.written(found.select(F.col("doc_id").alias(gone)).distinct(), "contaminated")
    rows = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(found, F.col(row) == F.col(gone), "left_anti").drop(row)


def op10_benchmark_decontamination(spark, sf_dir):
    """A row per document and benchmark item that share a passage: how much of it matches, and where it stands.

    Null and empty texts share none; repeated documents and items give repeated pairs; null doc_ids stay null; items
    without an id or text are ignored; empty tables give no row.
    """
    return contaminated(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "benchmark"))
