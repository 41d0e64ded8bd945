"""Memory reservations as decisions over rows of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headroom(available: Column, reserved: Column, size: Column) -> Column:
    return available - (reserved + size)


def overbooking(available: Column, reserved: Column, size: Column) -> Column:
    """Bytes by which a request would go beyond what is available."""
    return F.greatest(F.lit(0), -headroom(available, reserved, size))


def reserve(df: DataFrame, available: str = "available", reserved: str = "reserved", size: str = "size", allow_overbooking: bool = False) -> DataFrame:
    """Adds ``overbooked`` and ``granted``: all of the request, or nothing where it overbooks and may not."""
    over = overbooking(F.col(available), F.col(reserved), F.col(size))
    granted = F.col(size) if allow_overbooking else F.when(over > 0, F.lit(0)).otherwise(F.col(size))
    return df.withColumn("overbooked", over.cast("bigint")).withColumn("granted", granted.cast("bigint"))


def first_fitting_tier(size: Column, available: dict[str, Column]) -> Column:
    """The first tier, in the order given, with room for ``size``; null where none has."""
    out = F.lit(None).cast("string")
    for tier, room in reversed(list(available.items())):
        out = F.when(room >= size, F.lit(tier)).otherwise(out)
    return out


def next_granted(df: DataFrame, available: Column | int, partition_by: list[str], size: str = "size", delta: str = "net_memory_delta", seq: str = "seq") -> DataFrame:
    """Of the waiting requests that fit, per memory, that which frees most: least delta, then size, then oldest."""
    order = Window.partitionBy(*partition_by).orderBy(F.asc(delta), F.asc(size), F.asc(seq))
    return df.where(F.col(size) <= available).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def forced(df: DataFrame, partition_by: list[str], size: str = "size", delta: str = "net_memory_delta", seq: str = "seq") -> DataFrame:
    """What is granted when nothing moved for too long: the smallest request, then least delta, then oldest."""
    order = Window.partitionBy(*partition_by).orderBy(F.asc(size), F.asc(delta), F.asc(seq))
    return df.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def check_size(size: int) -> int:
    """A reservation's size: a whole number from 0 up to what 64 bits hold."""
    if not isinstance(size, int) or isinstance(size, bool) or size < 0:
        raise ValueError(f"not a reservation size: {size!r}")
    if size >= 1 << 64:
        raise OverflowError("reservation size over 64 bits")
    return size
