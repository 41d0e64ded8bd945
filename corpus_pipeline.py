"""The training-corpus pipeline: each stage reads what its predecessor kept and decides on whole documents.

toxicity drops toxic documents, line_dedup repeated lines, simhash all but one of each group of near-duplicates,
decontamination documents that hold benchmark passages; packing puts the rest into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _shared, decontaminate, line_dedup, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.7 or more go; the model learns from the labelled documents among those given.

    Null and empty texts score lowest and stay, rows that repeat stay or go together, an empty table stays empty.
    """
    model = toxicity.train(docs, _shared.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without lines that are near-copies of an earlier one; ``n_chars`` follows the text.

    Null texts stay null, repeated rows lose the same lines, and of lines that tie the smallest doc_id and place stays.
    """
    out = line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: SimHash finds the candidates, a five-word similarity of 0.8 or more links them.

    The smallest doc_id stays, a null one first; texts without words, null ones among them, are one group; repeated rows are one.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go, all rows of them; null texts stay; an empty table stays empty."""
    return decontaminate.without_contaminated(docs, _shared.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens; a null text is one piece of id 0."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: Hashing, learning and tokenizing have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet and read again by the next."""
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = _shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
