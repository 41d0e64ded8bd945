"""Best-fit packing of tokenized documents into sequences, online and in bounded space.

Pieces are dealt into groups of bounded size and arrive in each in the order of the input. A group is packed online: a
fixed number of bins is open, far fewer than a group has pieces, a bitset keyed by free space finds the fullest bin that
a piece still fits, and where another bin must open, the fullest closes. At a group's end the bins that are all but full
close as well; what is in the others is dealt anew into fewer groups. Groups never grow: where dealing anew leaves
nearly as much open as before, or one group is left, the open bins close as they are. Only lengths travel; tokens stay
with their documents.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared
from weftline.llm._worker import slices, worker_memory

CAPACITY = 2048
#: Signs that may set words apart, rarest first; the first that is one token serves.
MARKS = "★→•♥™^~"
END_MARKS = b".,!?;:"
#: Beyond these, composing characters could meet lower-casing; such texts keep their case until the tokenizer.
HIGH = re.compile("[\u0300-\U0010ffff]")
CACHE = 600_000


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, through a cache of encoded words.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its words' ids in order.
    Words are cut at ASCII white space. New ones are encoded together: words of letters alone are told apart by the
    tokens that end a word, others by a mark between them that is one token and one word. A punctuation sign at a
    word's end is a token of its own, so the word is learned once for all of them. The tokenizer lower-cases, so A-Z
    are lowered first. Texts that hold the mark or a special token's start go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends = {bytes([c]): self.whole(chr(c)) for c in END_MARKS}
        alone = {m: ids[0] for m in MARKS if len(ids := self.tokenizer.encode(m, add_special_tokens=False).ids) == 1}
        self.sign, self.mark = next(iter(alone.items()), (None, None))
        self.between = f" {self.sign} ".encode()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = None
        if suffix:
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Makes all words known. Of two generations of the cache the older goes when the younger is full; what is met stays."""
        if len(self.words) > CACHE // 2:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        words = words.difference(known)
        met = words.intersection(older)
        for w in met:
            known[w] = older[w]
        words = words - met
        ends = {w: w[:-1] for w in words if w[-1:] in END_MARKS and w[-2:-1].isalpha()}
        new = [w for w in {ends.get(w, w) for w in words}.difference(known)]
        plain = [w for w in new if w.isalpha() or w.decode().isalpha()] if self.closes is not None else []
        self.split_at(plain, b" ", lambda ids: np.flatnonzero(self.closes[ids]) + 1, 0)
        self.split_at(list(set(new).difference(plain)), self.between, lambda ids: np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        for w, bare in ends.items():
            known[w] = known[bare] + self.ends[w[-1:]]

    def split_at(self, words: list[bytes], between: bytes, stops, gap: int) -> None:
        """Encodes words together; ``stops`` finds each one's end among the ids, ``gap`` ids before the next begins."""
        lines = [words[at : at + 256] for at in range(0, len(words), 256)]
        for some, found in zip(lines, self.tokenizer.encode_batch_fast([between.join(x).decode() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = 4 * stops(ids)
            if len(cuts) != len(some):
                self.words.update((w, self.whole(w.decode())) for w in some)
                continue
            data, firsts = ids.tobytes(), np.concatenate(([0], cuts[:-1] + 4 * gap))
            self.words.update(zip(some, [data[i:j] for i, j in zip(firsts.tolist(), cuts.tolist(), strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of a part of a batch, whose words are all held at once."""
        odd = [self.sign is None or self.sign in t or "<|" in t for t in texts]
        split = [[] if o else (t.encode().lower() if HIGH.search(t) is None else t.encode()).split() for t, o in zip(texts, odd, strict=True)]
        self.learn(set().union(*split))
        get = self.words.__getitem__
        return [self.whole(t) if o else b"".join(map(get, s)) for t, s, o in zip(texts, split, odd, strict=True)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian bytes, where asked for).

    A document's ids are its text's, then id 0; null texts count as empty. Documents of at most ``capacity`` ids are
    one piece; longer ones are cut into pieces of ``capacity``, the last of which may be shorter.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encoders = worker_memory().setdefault("encoders", {})
        encoder = encoders[tokenizer] = encoders.get(tokenizer) or Encoder(tokenizer)
        for b in (part for whole in batches for part in slices(whole, 1, 4 << 20)):
            rows, ids = [], []
            for doc_id, data in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                data += b"\0\0\0\0"
                n = len(data) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    own = data[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, k, start, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        ids.append(own)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int, most_open: int, slack: int = 0) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece in order of arrival, and the bins that are open at the end with over ``slack`` free.

    A piece goes to the open bin with the least free space that holds it, the longest open of equals; where none
    does, a new bin opens, and if ``most_open`` are open already, the fullest of them closes first.
    """
    if lengths and max(lengths) > capacity:
        raise ValueError(f"a piece of {max(lengths)} is longer than {capacity}")
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, n_open, made = 0, 0, 0
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i, size in enumerate(lengths):
        fits = bits >> size
        if fits:
            free = size + ((fits & -fits).bit_length() - 1)
            own = by_free[free]
            chosen = own.pop(0)
            if not own:
                bits &= ~(1 << free)
            n_open -= 1
        else:
            if n_open == most_open:
                fullest = (bits & -bits).bit_length() - 1
                own = by_free[fullest]
                own.pop(0)
                if not own:
                    bits &= ~(1 << fullest)
                n_open -= 1
            free, chosen = capacity, made
            made += 1
        bins[i], offsets[i] = chosen, capacity - free
        free -= size
        if free:
            insort(by_free[free], chosen)
            bits |= 1 << free
            n_open += 1
    return bins, offsets, sorted(x for own in by_free[slack + 1 :] for x in own)


def pack(found: DataFrame, capacity: int = CAPACITY, most_open: int = 512, group_rows: int = 16384, slack: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (columns doc_id, piece, length; other columns are kept, but for older ones of these two names).

    Every piece gets a place, repeated rows one each; pieces of equal length are told apart by their order alone. Null
    lengths count as 0, lengths beyond ``capacity`` raise. An empty table gives an empty result. ``group_rows`` is the
    mean size of a group at every level and so bounds a task's memory; ``most_open`` the bins open at once. Pieces arrive
    in the order of ``found``; with a bound that no group can reach (``most_open`` of ``group_rows`` or more) nothing is
    lost by waiting, so they arrive longest first. Bins with at most ``slack`` tokens free (a 128th of the capacity where
    not given) are full enough at a group's end. Pieces as long as a sequence fill one by themselves.
    """
    slack = capacity // 128 if slack is None else slack
    row = _shared.unused(found, "row")
    rows, _ = _shared.written(found.drop("sequence_id", "offset").withColumn(row, F.monotonically_increasing_id()), "pieces")
    order = ["group", F.desc("length"), "row"] if most_open >= group_rows else ["group", "row"]
    todo, done, level = rows.select(F.col(row).alias("row"), F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length")), [], 0
    count = todo.count()
    while True:
        groups = max(1, -(-count // group_rows))
        dealt = todo.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        placed, _ = _shared.written(dealt.repartition("group").sortWithinPartitions(*order).groupBy("group").applyInArrow(_packed(level, capacity, most_open, slack), PLACED), "packed")
        left = placed.where("open").select("row", "length")
        before, count = count, left.count()
        last = groups == 1 or count > SHRINKS * before
        done.append((placed if last else placed.where(~F.col("open"))).select("row", "sequence_id", "offset"))
        if last or not count:
            break
        todo, level = left, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return rows.join(out.withColumnRenamed("row", row), row).drop(row)


#: Pieces are dealt anew only where at most this share of them was left in open bins.
SHRINKS = 0.9
PLACED = "row bigint, length bigint, sequence_id bigint, offset bigint, open boolean"


def _packed(level: int, capacity: int, most_open: int, slack: int):
    """Packs a group; its bins are numbered within the level and the group."""

    def run(keys, group):
        lengths = group.column("length").to_pylist()
        bins, offsets, left = best_fit(lengths, capacity, most_open, slack)
        open_bins = set(left)
        base = (level << 54) + (keys[0].as_py() << 28)
        return pa.table({"row": group.column("row"), "length": group.column("length"), "sequence_id": pa.array([base + x for x in bins], pa.int64()), "offset": pa.array(offsets, pa.int64()), "open": pa.array([x in open_bins for x in bins], pa.bool_())})

    return run


def op4_best_fit_packing(spark, sf_dir):
    """All documents, tokenized and packed into sequences of at most 2048 tokens; a row per piece.

    Null and empty texts are one piece of id 0; repeated rows and repeated doc_ids are packed one by one, null doc_ids
    stay null; an empty table gives no row.
    """
    import public_tokenizers

    return pack(pieces(_shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
