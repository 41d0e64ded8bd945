"""Cases that the operators' own tests leave out: scale bounds, clashing columns, and the registered queries."""

import random
import struct
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import _shared, decontaminate, license_scan, line_dedup, packing, quality, queries, simhash, suffix_dedup, toxicity

from .conftest import docs_frame
from .test_packing import check_places
from .test_quality import brute_stats
from .test_simhash import brute_components, brute_fingerprint
from .test_suffix_dedup import brute as brute_repeats
from .test_toxicity import brute_segments

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def test_like_lengths_stay_in_groups(spark):
    """Nothing fits together, so all that is left open would be dealt anew for ever: groups stay as small as they are."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1100).cast("bigint").alias("length"))
    packed = packing.pack(rows, most_open=16, group_rows=200).collect()
    assert len(packed) == 4000 == check_places(packed, packing.CAPACITY)
    assert max(Counter(r["sequence_id"] >> 28 for r in packed).values()) < 400


def test_the_fullest_closes(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 2048) for _ in range(6000)]
    bins, _, left = packing.best_fit(lengths, 2048, 64)
    assert len(left) <= 64 < len(set(bins))
    rows = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    assert check_places(packing.pack(rows).collect(), 2048) <= 1.05 * sum(lengths) / 2048
    with pytest.raises(ValueError):
        packing.best_fit([2049], 2048, 64)


def brute_licenses(text):
    """All templates over all stretches of words: licenses with the places of their longest notices."""
    own, hits = license_scan.words(text), []
    for t in license_scan.as_templates(license_scan.TEMPLATES):
        for a in range(len(own)):
            for b in range(a + len(t.words) - t.wrong, min(len(own), a + len(t.words) + t.wrong) + 1):
                missing, added, x, y = license_scan.differences(t.words, own[a:b])
                if (x, y) == (0, b - a) and not t.needed & set(missing) and not any(w in license_scan.NAMING for w in added) and license_scan.wrong_words(t.words, own[a:b]) <= t.wrong:
                    hits.append((b - a - len(added), a, b, t.license))
    taken = []
    for _, a, b, name in sorted(hits, key=lambda h: (-h[0], h[1])):
        if all(b <= c or a >= d for c, d, _ in taken):
            taken.append((a, b, name))
    return [name for _, _, name in sorted(taken)]


def test_licenses_wrapped_commented_and_reworded(spark):
    texts, want = [], []
    for name, some in license_scan.TEMPLATES.items():
        for t in some:
            for mark in ("# ", " * ", ""):
                texts.append("lorem ipsum\n" + "\n".join(mark + x for x in textwrap.wrap(t, 60)) + "\ndolor")
                want.append([name])
    plain = ["Licensed under the MIT License", "the Apache License 2.0 applies", "under GNU General Public Licence, version 3", "version 2 of the GNU General Public License", "all rights are reserved here", "a licensed driver, general public, version 3", "Released under the MIT License. All rights reserved."]
    texts += plain
    want += [["MIT"], ["Apache-2.0"], ["GPL-3.0"], ["GPL-2.0"], [], [], ["MIT", "proprietary"]]
    got: dict[int, list[str]] = {}
    for r in license_scan.scan_licenses(docs_frame(spark, texts)).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert [got.get(k, []) for k in range(len(texts))] == want
    assert [got.get(len(texts) - len(plain) + k, []) for k in range(len(plain))] == [brute_licenses(t) for t in plain]


@pytest.mark.parametrize("seed", range(20))
def test_segments_of_any_scores(seed):
    scores = np.round(np.random.default_rng(seed).normal(-0.2, 1.0, 14), 3)
    got = toxicity.scored_segments(scores)
    want = brute_segments(scores.tolist())
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want] and [s for s, _, _ in got] == pytest.approx([s for s, _, _ in want])


def test_toxicity_on_held_out_rows(spark):
    labels = _shared.table(spark, LARGER, "labels").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    rows = toxicity.op3_toxicity_segments(spark, LARGER)
    assert rows.where("held_out IS NULL").count() == 0
    found = Counter((r["toxic"], r["predicted"]) for r in rows.join(labels, "doc_id").where("held_out").collect())
    assert found[1, 1] >= 0.8 * (found[1, 1] + found[1, 0]) and found[0, 1] <= 0.03 * (found[0, 0] + found[0, 1])


def test_quality_against_labels(spark):
    labels = _shared.table(spark, LARGER, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    rows = quality.op9_quality_rules(spark, LARGER).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.98 * len(rows)


def test_common_stems_tell_nothing(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    stem = text(15)
    items = [f"{stem} {text(20)}" for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = docs_frame(spark, [f"{text(30)} {stem} {text(30)}", f"{text(30)} {items[7]} {text(30)}"])
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 7)]


def test_long_runs_and_crowded_minimizers(spark):
    rng = random.Random(4)
    boiler = "the same boilerplate again, " * 3
    texts = ["z" * 300_000, "ab" * 20_000] + [boiler + "".join(rng.choices("abcdefgh", k=160)) + boiler for _ in range(60)]
    rows = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs_frame(spark, texts), hot=10).collect()}
    assert rows[0][1] == 300_000 and rows[1][1] == 40_000
    assert [rows[k] for k in range(2, 62)] == [x[:4] for x in brute_repeats(texts[2:])]


def test_clashing_columns(spark, awkward):
    names = ["d", "r", "dropped", "_row", "_key", "row_of", "key", "n", "sequence_id", "offset", "group", "h1", "k", "w0", "component"]
    wide = awkward.drop("row").select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    bench = spark.createDataFrame([(1, "nothing like it")], "item_id bigint, text string")
    for out in (line_dedup.without_repeated_lines(wide), simhash.one_of_each(wide), decontaminate.without_contaminated(wide, bench), toxicity.keep_clean(wide, toxicity.Model())):
        assert out.columns == wide.columns and all(r[c] == k for r in out.collect() for k, c in enumerate(names))
    pieces = packing.pieces(awkward, public_tokenizers.path("word_bpe_49k.json")).withColumn("row", F.lit(7))
    assert {r["row"] for r in packing.pack(pieces).collect()} == {7}


SCHEMAS = {
    "op2_hmm_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_toxicity_segments": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_warc_chunks": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_simhash_near_duplicates": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_columns_of_queries(spark, name):
    got = dict(queries.QUERIES[name](spark, SF).dtypes)
    assert {c.split()[0]: c.split()[1] for c in SCHEMAS[name].split(", ")}.items() <= got.items()


def test_queries_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in _shared.table(spark, SF, "documents").orderBy("doc_id").collect()]
    texts = [t for _, t in docs]
    rows = lambda f: sorted(f(spark, SF).collect(), key=lambda r: r["doc_id"])

    fps = [(d, brute_fingerprint(t, 4)) for d, t in docs]
    got = rows(simhash.op7_simhash_near_duplicates)
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got] == [(d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps, 4), strict=True)]

    got = rows(suffix_dedup.op8_suffix_dedup)
    assert [tuple(r)[1:5] for r in got] == [x[:4] for x in brute_repeats(texts)]

    got = rows(quality.op9_quality_rules)
    assert [tuple(r)[1:6] for r in got] == [brute_stats(t) for t in texts]
    assert [r["base_failed"] for r in got] == [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in map(brute_stats, texts)]

    plain, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k, s, len(ids[s : s + 2048]), zlib.crc32(struct.pack(f"<{len(ids[s : s + 2048])}I", *ids[s : s + 2048]))) for k, s in enumerate(range(0, len(ids), 2048))]
    got = packing.op4_best_fit_packing(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    check_places(got, 2048)
