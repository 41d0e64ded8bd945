"""Partition-ownership functions: which rank owns which partition id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Owner = Callable[[Column, int, int], Column]


def _positive(name: str, value: int) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be positive, got {value}")
    return value


def round_robin(pid: Column | str, nranks: int, total: int | None = None) -> Column:
    """Rank ``pid mod nranks``."""
    pid = F.col(pid) if isinstance(pid, str) else pid
    return F.pmod(pid, F.lit(_positive("nranks", nranks)))


def contiguous(pid: Column | str, nranks: int, total: int) -> Column:
    """Rank ``floor(pid * nranks / total)``: adjacent partitions share a rank, so range order is kept."""
    pid = F.col(pid) if isinstance(pid, str) else pid
    n, p = _positive("nranks", nranks), _positive("total", total)
    product = pid.cast("bigint") * F.lit(n).cast("bigint")
    return F.floor((product - F.pmod(product, F.lit(p))) / F.lit(p)).cast("bigint")


OWNERS: dict[str, Owner] = {"round_robin": round_robin, "contiguous": contiguous}


def resolve(owner: str | Owner) -> Owner:
    """A named owner, or any callable ``(pid, nranks, total) -> Column``."""
    if callable(owner):
        return owner
    if owner.lower() not in OWNERS:
        raise ValueError(f"unknown owner {owner!r}; known: {sorted(OWNERS)}")
    return OWNERS[owner.lower()]


def local_partitions(spark: SparkSession, total: int, nranks: int, rank: int | None = None, owner: str | Owner = "round_robin") -> DataFrame:
    """Partition ids with their rank, ascending; of one rank where ``rank`` is given. A rank may own none."""
    _positive("total", total)
    if rank is not None and not 0 <= rank < nranks:
        raise ValueError(f"rank {rank} is outside [0, {nranks})")
    ids = spark.range(total).select(F.col("id").alias("pid"))
    ids = ids.withColumn("rank", resolve(owner)(F.col("pid"), nranks, total).cast("bigint"))
    return ids if rank is None else ids.where(F.col("rank") == rank)


def chunk_indices(spark: SparkSession, count: int, k: int) -> DataFrame:
    """``k`` front-loaded half-open ranges over ``[0, count)``; trailing ones may be empty."""
    _positive("k", k)
    if count < 0:
        raise ValueError("count must not be negative")
    step = -(-count // k)
    at = F.col("id")
    return spark.range(k).select(
        at.alias("chunk"),
        F.least(at * step, F.lit(count)).cast("bigint").alias("begin"),
        F.least((at + 1) * step, F.lit(count)).cast("bigint").alias("end"),
    )
