"""Which objects a spill takes: each policy is a selection over rows.

All of them walk objects in a fixed order and stop once enough bytes are taken: an object goes if what went before it
is less than the amount asked for. Running sums stay within ``partition_by`` (a rank, a device): the objects of one
memory are few, those of all memories need not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _non_negative(amount: int) -> int:
    if amount < 0:
        raise ValueError("the amount to spill must not be negative")
    return amount


def _until(df: DataFrame, order: list[Column | str], size: str, amount: Column | int, partition_by: list[str]) -> DataFrame:
    window = Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(size).cast("bigint")).over(window), F.lit(0)).cast("bigint")
    return df.withColumn("spilled_before", before).where(F.col("spilled_before") < amount)


def fifo(df: DataFrame, amount: int, order: str = "id", size: str = "nbytes", spillable: Column | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Oldest first among spillable objects."""
    rows = df if spillable is None else df.where(spillable)
    return _until(rows, [order], size, _non_negative(amount), partition_by or [])


def by_tier(df: DataFrame, amount: int, order: str = "id", size: str = "nbytes", tier: str = "mem_type", partition_by: list[str] | None = None) -> DataFrame:
    """Oldest first among objects in device memory, as a collection of weakly held objects spills."""
    return fifo(df, amount, order, size, F.upper(F.col(tier)) == "DEVICE", partition_by)


def received_chunks(df: DataFrame, amount: int, pid: str = "pid", chunk_id: str = "chunk_id", size: str = "nbytes", movable: Column | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Received chunks by partition and chunk id, empty and control chunks passed over."""
    rows = df.where(F.col(size) > 0)
    rows = rows if movable is None else rows.where(movable)
    return _until(rows, [pid, chunk_id], size, _non_negative(amount), partition_by or [])


def priority_cascade(functions: DataFrame, amount: int, priority: str = "priority", registered: str = "registered", can_spill: str = "can_spill", partition_by: list[str] | None = None) -> DataFrame:
    """Spill functions by falling priority, in order of registration within one: what each is asked for and gives.

    Each gets what is left of the amount and gives at most what it can; those not reached any more aren't called.
    """
    _non_negative(amount)
    called = _until(functions, [F.desc(priority), F.asc(registered)], can_spill, amount, partition_by or [])
    asked = (F.lit(amount) - F.col("spilled_before")).cast("bigint")
    return called.withColumn("asked", asked).withColumn("spilled", F.col(can_spill).cast("bigint"))


def headroom_amount(headroom: Column, available: Column) -> Column:
    """Bytes to spill so that ``headroom`` becomes available."""
    return F.greatest(F.lit(0), headroom - available)


def best_fit(df: DataFrame, amount: int, order: str = "id", size: str = "nbytes", partition_by: list[str] | None = None) -> DataFrame:
    """Chunks in the ``place`` they are taken: the smallest that covers what is left, or else the largest of all.

    A chunk that doesn't cover what is left is only ever taken as the largest, so the choices are the largest chunks in
    turn, up to the first that would cover what is left at its turn, and then the smallest that covers it. All of a
    memory's chunks go where they don't suffice. Of equal sizes the youngest is the largest, the oldest the smallest.
    """
    keys = partition_by or []
    size_of = F.col(size).cast("bigint")
    falling = Window.partitionBy(*keys).orderBy(F.desc(size), F.desc(order))
    before = F.coalesce(F.sum(size_of).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.where(F.col(size) > 0).withColumn("_left", F.lit(_non_negative(amount)) - before).withColumn("place", F.row_number().over(falling).cast("bigint") - 1)
    covers = (F.col("_left") > 0) & (size_of >= F.col("_left"))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_stop", F.max(F.when(covers, F.col("_left"))).over(whole))
    early = (F.col("_left") > 0) & (F.col("_stop").isNull() | (F.col("_left") > F.col("_stop")))
    rows = rows.withColumn("_early", early).withColumn("_taken", F.sum(F.col("_early").cast("bigint")).over(whole))
    can_end = ~F.col("_early") & (F.col("_stop").isNotNull()) & (size_of >= F.col("_stop"))
    last = F.row_number().over(Window.partitionBy(*keys, F.col("_ends")).orderBy(F.asc(size), F.asc(order)))
    rows = rows.withColumn("_ends", can_end).withColumn("_nth", last)
    kept = rows.where(F.col("_early") | (F.col("_ends") & (F.col("_nth") == 1)))
    return kept.withColumn("place", F.when(F.col("_early"), F.col("place")).otherwise(F.col("_taken"))).drop("_left", "_stop", "_early", "_taken", "_ends", "_nth")
