"""Removal of repeated byte strings by two-stage suffix sorting.

A string of ``span`` bytes counts as repeated if it also starts anywhere else. Each window of that length is known by
its minimizer, the least hash of the k-byte strings within it: equal windows have equal minimizers, so a window whose
minimizer occurs once is unique and is never looked at again. What is left travels as segments of text, grouped by
minimizer, equal segments once. A task sorts the suffixes of its segments in two stages: suffixes smaller than their
successors are sorted directly, the others are induced from their successors by one scan of the buckets. Windows that
share ``span`` bytes with a neighbour in that order are repeated. Where a minimizer has more distinct segments than a
task should sort, they are cut anew at their minimizers under another hash, which stand beside the first in the key, and
so on; what three such cuts leave together is settled window by window, through a hash of each that is counted and joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared

SPAN = 200
GRAM = 32
#: Distinct segments of one key that are sorted in one task.
HOT = 5_000
#: Their bytes likewise; suffixes of so many are sorted in some 100 MB.
HOT_BYTES = 1 << 20
CUTS = 3
#: Windows of one segment; a run of one byte has one minimizer throughout.
MOST_STARTS = 4096
BLOCK = 1 << 19
#: Rows whose nested places are Python objects at one time.
ROWS = 256
MIXED = np.random.default_rng(20).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEY = ("doc_id", "row")


def gram_hashes(data: np.ndarray, gram: int = GRAM, salt: int = 0) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each place on, another one for each salt."""
    h, width, factor = MIXED[data], 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = (factor * factor + 2) % (1 << 64)
        width *= 2
    h ^= (h >> np.uint64(29)) + np.uint64(salt * 0x94D049BB133111EB % (1 << 64))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def minimizer_runs(data: np.ndarray, span: int = SPAN, gram: int = GRAM, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first start, number of starts and occurrences (1, or 2 for more) of each run of windows with one minimizer."""
    block = 1 << 22
    none = np.zeros(0, np.int64)
    keys, starts, places = [], [], []
    for base in range(0, max(0, len(data) - span + 1), block):
        part = data[base : base + block + span - 1]
        h = gram_hashes(part, gram, salt)
        low = np.uint64((1 << 24) - 1)
        best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, want = 1, span - gram + 1
        while width < want:
            step = min(width, want - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        place = (best & low).astype(np.int64)
        key = h[place]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]))))
        keys.append(key[new])
        starts.append(new + base)
        places.append(place[new] + base)
    if not keys:
        return none.astype(np.uint64), none, none, none
    key, start = np.concatenate(keys), np.concatenate(starts)
    total = len(data) - span + 1
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    moved = np.add.reduceat(np.concatenate(([0], np.concatenate(places)[1:] != np.concatenate(places)[:-1])).astype(np.int64), first)
    moved[1:] -= 1  # the step into a run is not one within it
    counts = np.diff(np.append(start[first], total))
    return key[first], start[first], counts, np.where(moved > 0, 2, 1)


def within(runs: tuple[np.ndarray, ...], most: int = MOST_STARTS) -> tuple[np.ndarray, ...]:
    """Runs of at most ``most`` starts each."""
    key, start, count, occurs = runs
    if not (count > most).any():
        return runs
    parts = -(-count // most)
    of = np.repeat(np.arange(len(count)), parts)
    after = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    return key[of], start[of] + after, np.minimum(count[of] - after, most), occurs[of]


def is_smaller(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each place, whether its suffix is smaller than the next one's; ``ends`` marks the last byte of each segment."""
    n = len(text)
    less = np.zeros(n, bool)
    greater = np.ones(n, bool)
    if n > 1:
        less[:-1] = text[:-1] < text[1:]
        greater[:-1] = text[:-1] > text[1:]
    less[ends], greater[ends] = False, True
    known = np.flatnonzero(less | greater)
    return less[known[np.searchsorted(known, np.arange(n))]]


def two_stage(text: bytes, bounds: np.ndarray, wanted: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The wanted places of ``text`` in the order of their suffixes' first ``depth`` bytes.

    ``bounds`` are the ends of the segments, beyond which no suffix goes; ``wanted`` marks places. Suffixes smaller
    than their successors are sorted directly. Each other suffix stands in its bucket (first byte) in the order of its
    successor, so one scan of the buckets, lowest first, places them all: a bucket's induced suffixes come before its
    sorted ones, and those of equal bytes in a row follow from one another within the bucket.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.zeros(n, bool)
    ends[bounds - 1] = True
    small = is_smaller(data, ends)
    # A suffix is needed if it is wanted, or is the successor of a needed one that must be induced.
    stop = np.flatnonzero(small | ends)
    last = np.flatnonzero(wanted)
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, last, 1)
    np.add.at(reach, stop[np.searchsorted(stop, last)] + 1, -1)
    needed = np.cumsum(reach[:-1]) > 0
    limit = bounds[np.searchsorted(bounds, np.arange(n), "right")]
    direct = np.flatnonzero(small & needed)
    direct = direct[np.argsort(data[direct], kind="stable")]
    sorted_from = np.searchsorted(data[direct], np.arange(257))
    for low, high in zip(sorted_from[:-1].tolist(), sorted_from[1:].tolist(), strict=True):  # a bucket's suffixes are cut out at a time
        own = direct[low:high]
        tails = [text[a:b] for a, b in zip(own.tolist(), np.minimum(own + depth + 1, limit[own]).tolist(), strict=True)]
        direct[low:high] = own[np.array(sorted(range(len(tails)), key=tails.__getitem__), np.int64)]
    del tails
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    to_induce = needed & ~small
    final = np.flatnonzero(ends & to_induce)  # their successor is the empty suffix, the least of all
    for c in np.unique(data[final]):
        induced[c].append(final[data[final] == c])
    out = []
    segment_start = np.zeros(n + 1, bool)
    segment_start[0] = True
    segment_start[bounds] = True

    def scan(places: np.ndarray) -> None:
        before = places[~segment_start[places]] - 1
        before = before[to_induce[before]]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(first)), strict=True):
                induced[first[a]].append(before[a:b])

    for c in range(256):
        own = induced[c]
        k = 0
        while k < len(own):  # grows while equal bytes in a row are found
            out.append(own[k])
            scan(own[k])
            k += 1
        rest = direct[sorted_from[c] : sorted_from[c + 1]]
        if len(rest):
            out.append(rest)
            scan(rest)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def shares_prefix(text: bytes, order: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Of each place in suffix order, whether it has ``depth`` bytes in common with the one before or after it."""
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    padded = np.frombuffer(text + bytes(8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1)).copy().view("<u8").ravel()
    pair = np.arange(len(order) - 1)
    a, b = order[:-1], order[1:]
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        same = words[a + at] == words[b + at]
        pair, a, b = pair[same], a[same], b[same]
    out[pair] = True
    out[pair + 1] = True
    return out


def repeated_starts(texts: list[bytes], counts: list[int], span: int = SPAN) -> list[np.ndarray]:
    """Of each segment, which of its first ``counts`` windows start again anywhere among the segments."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(sizes)
    starts = bounds - sizes
    text = b"".join(texts)
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + np.array(counts), -1)
    wanted = np.cumsum(mark[:-1]) > 0
    order = two_stage(text, bounds, wanted, span)
    hit = np.zeros(len(text), bool)
    hit[order[shares_prefix(text, order, span)]] = True
    return [hit[s : s + c] for s, c in zip(starts.tolist(), counts, strict=True)]


def ranges(hit: np.ndarray) -> list[int]:
    """Half-open runs of true values, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.tolist()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, as they travel twice."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [press.compress(t.as_buffer()) if len(t.as_buffer()) else b"" for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["doc_id", "row", "z"])

    return rows.select("doc_id", "row", "text").mapInArrow(run, "doc_id bigint, row bigint, z binary")


def _few_rows(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnRenamed("doc_id", "d").withColumnRenamed("row", "r")
    return left.join(right, left["doc_id"].eqNullSafe(right["d"]) & (left["row"] == right["r"]), how).drop("d", "r")


def remove_repeats(docs: DataFrame, span: int = SPAN, hot: int = HOT, with_text: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept`` bytes where asked for) per row.

    Every byte covered by a string of ``span`` bytes that also starts elsewhere, in the same text or another, is
    removed; strings are judged on the input. Null texts are empty. Repeated rows are texts like any others, so they
    remove each other. Rows are told apart by doc_id and a 64-bit hash of the text; columns other than doc_id and text
    are ignored; an empty table gives an empty result. Documents are read whole; tasks hold one document and one block
    of segments at a time. ``hot`` is the number of distinct segments beyond which a key is cut anew, ``hot_bytes`` that of
    their bytes.
    """
    rows = _keyed(docs)

    def find(batches):
        for b in batches:
            parts = [[], [], [], [], [], []]
            held = 0
            for doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                if len(data) < span:
                    continue
                found = within(minimizer_runs(data, span))
                n = len(found[0])
                for part, x in zip(parts, ([doc_id] * n, np.full(n, row), *found), strict=True):
                    part.append(x)
                held += n
            if held:
                arrays = [pa.array([x for p in parts[0] for x in p], pa.int64()), pa.array(np.concatenate(parts[1])), pa.array(np.concatenate(parts[2]).view(np.int64)), *(pa.array(np.concatenate(p).astype(np.int32)) for p in parts[3:5]), pa.array(np.concatenate(parts[5]).astype(np.int8))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "key", "start", "n", "occurs"])

    runs, runs_at = _shared.written(rows.select("doc_id", "row", "text").mapInArrow(find, "doc_id bigint, row bigint, key bigint, start int, n int, occurs tinyint"), "runs")
    often = runs.groupBy("key").agg(F.sum("occurs").alias("total")).where("total > 1").select("key")
    candidates = runs.join(often, "key").select("doc_id", "row", "start", "n", "key")
    candidates, _ = _shared.written(candidates, "candidates")
    _shared.remove(docs.sparkSession, runs_at)

    def cut(batches):
        for b in _few_rows(batches):
            out: list[list] = [[] for _ in SEGMENT]
            held = 0
            for doc_id, row, z, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = _unpacked(z)
                for p in places:
                    piece = text[p["start"] : p["start"] + p["n"] - 1 + span]
                    for column, x in zip(out, (doc_id, row, p["start"], p["n"], p["key"], xxhash.xxh3_128_digest(piece), piece), strict=True):
                        column.append(x)
                    held += len(piece)
                if held > 4 << 20:
                    yield _segments(out)
                    out, held = [[] for _ in SEGMENT], 0
            if held:
                yield _segments(out)

    wanted = candidates.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "key")).alias("places"))
    pieces = _joined(_packed(rows), wanted, "inner").select("doc_id", "row", "z", "places")
    segments = pieces.mapInArrow(cut, "doc_id bigint, row bigint, start int, n int, key bigint, sid binary, piece binary")
    path = _shared.new_folder(docs.sparkSession, "segments")
    segments.write.option("compression", "zstd").parquet(path)
    segments = docs.sparkSession.read.schema(segments.schema).parquet(path)
    def sort_blocks(batches):
        held: dict[int, list[tuple[bytes, int, bytes, int]]] = {}
        for b in batches:
            for key, sid, n, piece, copies in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                held.setdefault(key, []).append((sid, n, piece, copies))
        block, size = [], 0
        groups = list(held.values())
        del held
        while groups:
            own = groups.pop()
            block += own
            size += sum(len(x[2]) for x in own)
            if size > BLOCK or not groups:
                hits = repeated_starts([x[2] for x in block], [x[1] for x in block], span)
                found = [(sid, [0, n] if copies > 1 else ranges(hit)) for (sid, n, _, copies), hit in zip(block, hits, strict=True)]
                found = [x for x in found if x[1]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], ["sid", "at"])
                block, size = [], 0

    def cut_again(batches, salt):
        for b in batches:
            out: list[list] = [[] for _ in PART]
            held = 0
            for key, sid, piece, copies in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                keys, starts, counts, _ = within(minimizer_runs(np.frombuffer(piece, np.uint8), span, GRAM, salt))
                # Segments of one key alone are cut, so the new key and the old one together are a new key.
                keys = (keys ^ np.uint64(key % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
                for own, start, n in zip(keys.view(np.int64).tolist(), starts.tolist(), counts.tolist(), strict=True):
                    part = piece[start : start + n - 1 + span]
                    for column, x in zip(out, (sid, start, xxhash.xxh3_128_digest(part), own, n, part, copies), strict=True):
                        column.append(x)
                    held += len(part)
                if held > 4 << 20:
                    yield _arrays(out, PART)
                    out, held = [[] for _ in PART], 0
            if held:
                yield _arrays(out, PART)

    def settle(distinct: DataFrame, cuts: int) -> DataFrame:
        """``sid, at``: runs of repeated windows of the segments (sid, key, n, piece, copies)."""
        often, _ = _shared.written(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("piece")).alias("bytes")).where((F.col("m") > hot) | (F.col("bytes") > hot_bytes)).select("key"), "crowded-keys")
        if often.isEmpty():
            return distinct.select("key", "sid", "n", "piece", "copies").repartition("key").mapInArrow(sort_blocks, kind)
        crowded, _ = _shared.written(distinct.join(often, "key", "left_semi").select(*distinct.columns), "crowded")
        easy = distinct.join(often, "key", "left_anti").select("key", "sid", "n", "piece", "copies").repartition("key").mapInArrow(sort_blocks, kind)
        if not cuts:
            return easy.unionByName(by_window(crowded))
        salt = 1 + CUTS - cuts
        parts = crowded.select("key", "sid", "piece", "copies").mapInArrow(lambda batches: cut_again(batches, salt), ", ".join(f"{c} {t}" for c, t, _ in PART))
        parts, _ = _shared.written(parts, "parts")
        again = parts.groupBy("sid").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.first("piece").alias("piece"), F.sum("copies").alias("copies"))
        again, _ = _shared.written(again, "distinct")
        found = parts.select("of", "start", "sid").join(settle(again, cuts - 1), "sid")
        return easy.unionByName(found.select(F.col("of").alias("sid"), F.transform("at", lambda x: (x + F.col("start")).cast("int")).alias("at")))

    def by_window(some: DataFrame) -> DataFrame:
        each = some.select("sid", "n", "piece", "copies").mapInArrow(windows, "window binary, sid binary, k int, weight int")
        again = each.groupBy("window").agg(F.sum("weight").alias("total")).where("total > 1").select("window")
        return each.join(again, "window").groupBy("sid").agg(F.flatten(F.collect_list(F.array(F.col("k"), F.col("k") + 1))).alias("at"))

    kind = "sid binary, at array<int>"

    def windows(batches):
        for b in batches:
            for sid, n, piece, copies in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                weight = 2 if copies > 1 else 1
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(piece[k : k + span]) for k in range(n)], pa.binary()), pa.array([sid] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([weight] * n, pa.int32())], ["window", "sid", "k", "weight"])

    distinct = segments.groupBy("sid").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.first("piece").alias("piece"), F.count(F.lit(1)).alias("copies"))
    distinct, _ = _shared.written(distinct, "distinct")
    found = settle(distinct, CUTS)
    covered = segments.select("doc_id", "row", "start", "sid").join(found, "sid").groupBy(*KEY).agg(F.collect_set(F.struct("start", "at")).alias("spans"))

    def drop(batches):
        for b in _few_rows(batches):
            out = [[] for _ in range(5)]
            for z, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = _unpacked(z)
                gone = merged([(s["start"] + a, s["start"] + e - 1 + span) for s in spans or () for a, e in zip(s["at"][::2], s["at"][1::2], strict=True)])
                digest, at, kept = hashlib.sha256(), 0, []
                for a, e in [*gone, (len(text), len(text))]:
                    digest.update(text[at:a])
                    kept.append(text[at:a] if with_text else b"")
                    at = e
                for column, x in zip(out, (len(text), sum(e - a for a, e in gone), len(gone), digest.hexdigest(), b"".join(kept)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays[: 4 + with_text]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    whole = _joined(_packed(rows), covered, "left").select("doc_id", "z", "spans")
    return whole.mapInArrow(drop, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


SEGMENT = [("doc_id", "bigint", pa.int64()), ("row", "bigint", pa.int64()), ("start", "int", pa.int32()), ("n", "int", pa.int32()), ("key", "bigint", pa.int64()), ("sid", "binary", pa.binary()), ("piece", "binary", pa.binary())]
PART = [("of", "binary", pa.binary()), ("start", "int", pa.int32()), ("sid", "binary", pa.binary()), ("key", "bigint", pa.int64()), ("n", "int", pa.int32()), ("piece", "binary", pa.binary()), ("copies", "bigint", pa.int64())]


def _arrays(out: list[list], columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(out, columns, strict=True)], [name for name, _, _ in columns])


def _segments(out: list[list]) -> pa.RecordBatch:
    return _arrays(out, SEGMENT)


def op8_suffix_dedup(spark, sf_dir):
    """doc_id, the bytes of each document, how many are removed in how many runs, and the SHA-256 of what is kept.

    Null and empty texts have no byte; repeated rows remove each other; null doc_ids stay null; an empty table gives no row.
    """
    return remove_repeats(_shared.table(spark, sf_dir, "documents"))
