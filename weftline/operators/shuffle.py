"""Shuffles onto exact, hashed or ranged partitions, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ownership import Owner, resolve


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shuffle(df: DataFrame, pid: Column | str, total: int, payload: Column | str | None = None) -> DataFrame:
    """Every row lands in the Spark partition numbered by its ``pid``, one exchange in all.

    Null or out-of-range ids raise while the query runs. Where ``pid`` names an int column, aggregates and joins on it
    that follow need no exchange of their own. With ``payload`` given, rows whose payload is empty
    are skipped, as empty chunks are never sent.
    """
    if total <= 0:
        raise ValueError("total must be positive")
    if payload is not None:
        df = df.where(F.octet_length(_column(payload).cast("string")) > 0)
    at = _column(pid).cast("int")
    checked = F.when(at.isNull() | (at < 0) | (at >= total), F.raise_error(F.lit("partition id outside range")).cast("int")).otherwise(at)
    if isinstance(pid, str) and dict(df.dtypes).get(pid) == "int":
        return df.withColumn(pid, checked).repartitionById(total, pid)
    return df.repartitionById(total, checked)


def hash_shuffle(df: DataFrame, total: int, *keys: Column | str) -> DataFrame:
    """Rows with equal keys share a partition."""
    return df.repartition(total, *keys)


def range_shuffle(df: DataFrame, total: int, *keys: Column | str) -> DataFrame:
    """Ranges of the keys, each sorted: partitions read in order are globally sorted."""
    return df.repartitionByRange(total, *keys).sortWithinPartitions(*keys)


def owned(df: DataFrame, pid: Column | str, nranks: int, total: int, owner: str | Owner = "round_robin") -> DataFrame:
    """Adds ``rank``, the owner of the row's partition."""
    return df.withColumn("rank", resolve(owner)(_column(pid), nranks, total).cast("bigint"))


def extract(df: DataFrame, pid_column: str, pid: int) -> DataFrame:
    """Rows of one partition; none where nothing was inserted."""
    return df.where(F.col(pid_column) == pid)


def partition_totals(df: DataFrame, pid_column: str, total: int, *aggregates: Column) -> DataFrame:
    """One row per partition id, empty partitions included (their aggregates are null)."""
    ids = df.sparkSession.range(total).select(F.col("id").alias(pid_column))
    return ids.join(df.groupBy(F.col(pid_column).cast("bigint").alias(pid_column)).agg(*aggregates), pid_column, "left")


def payload_stats(df: DataFrame, src: str, dst: str, nbytes: Column | str) -> DataFrame:
    """Count, sum and largest payload sent by each source; self-transfers and empty payloads don't count."""
    size = _column(nbytes).cast("bigint")
    moved = df.where((F.col(src) != F.col(dst)) & (size > 0))
    return moved.groupBy(src).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("bigint").alias("total_bytes"), F.max(size).alias("max_bytes"))
