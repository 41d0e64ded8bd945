"""Structured Streaming forms: throttled sources, fanout into several sinks, running statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def source(spark: SparkSession, path: str, schema: StructType | str, tickets: int = 1) -> DataFrame:
    """Files of a folder as a stream, at most ``tickets`` of them a batch: the next is taken when these are done."""
    if tickets <= 0:
        raise ValueError("at least one ticket is needed")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", tickets).parquet(path)


def fanout(stream: DataFrame, paths: list[str], checkpoint: str) -> StreamingQuery:
    """Every batch to every path before the next is taken, as a bounded fanout does. At least two paths.

    A batch's files carry its number, so a batch that runs again after a failure replaces what it wrote.
    """
    if len(paths) < 2:
        raise ValueError("a fanout has at least two outputs")

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for p in paths:
                kept.write.mode("overwrite").parquet(f"{p}/batch={number}")
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_stats(stream: DataFrame, name: str, value: str) -> DataFrame:
    """``name, count, value, max`` so far, for output mode complete or update."""
    return stream.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("value"), F.max(F.col(value).cast("double")).alias("max"))


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there now, batch by batch, and returns when it is done."""
    query = stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def table_of(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """A small streaming result, run to the end of what is there, as an in-memory table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
