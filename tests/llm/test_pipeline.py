import os
import random
import struct
import subprocess
import sys
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import _shared, queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # with labels enough to learn from
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_take_effect(spark):
    documents = _shared.table(spark, LARGER, "documents")
    docs, sizes = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = _shared.written(stage(spark, docs, LARGER), f"test-{name}")
        assert out.columns == documents.columns and [f.dataType for f in out.schema] == [f.dataType for f in documents.schema]
        assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        docs = out
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, LARGER).count() == packed.count()


def test_planted_documents(spark, tmp_path):
    """What must go goes, at its stage, and the packed ids are those of a brute-force run over what must stay."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(4000)]
    insults = ["vilex", "nastyx", "grossx"]

    def text(lines, extra=()):
        rows = [rng.choices(vocabulary, k=rng.randint(9, 14)) for _ in range(lines)]
        for word in extra:
            rng.choice(rows).insert(4, word)
        return "\n".join(" ".join(r) for r in rows)

    toxic = {i: text(6, rng.choices(insults, k=3)) for i in range(200, 260)}
    clean = {i: text(rng.randint(5, 15)) for i in range(120)}
    items = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(5)]
    leaked = {300 + k: text(3) + "\n" + item + "\n" + text(2) for k, item in enumerate(items)}
    copies = {400 + k: clean[k] for k in range(4)}
    shared = {500: clean[5].split("\n")[0] + "\n" + text(4)}
    documents = clean | toxic | leaked | copies | shared
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in documents.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*clean, *toxic]], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want = dict(clean) | {500: "\n".join(shared[500].split("\n")[1:]), 400: ""}  # of the emptied copies one stays
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((i, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for i, t in want.items() for ids in [plain.encode(t, add_special_tokens=False).ids + [0]])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got) == expected


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 6), (6, 8), *((100 + k, 101 + k) for k in range(40)), *((500, 501 + k) for k in range(50))]
    got = dict(map(tuple, _shared.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    want = {x: 1 for x in (1, 2, 3)} | {x: 6 for x in (6, 7, 8, 9)} | {5: 5} | {100 + k: 100 for k in range(41)} | {500 + k: 500 for k in range(51)}
    assert got == want
    assert _shared.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_entry_without_this_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert said.stdout.split()[1] == "False"
