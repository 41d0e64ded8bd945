"""Memory records: what a scope holds, held at most, and allocated in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.running import block_of


def scope_records(events: DataFrame, scope: str = "scope", t: str = "t", delta: str = "delta") -> DataFrame:
    """Per scope: ``current, peak, total, max, n_alloc, n_dealloc`` from signed allocation events in order of ``t``.

    The peak starts at nothing, so a scope that only frees has a peak of 0. Events (``t`` is a whole number) are run over
    by blocks of time; a scope's blocks, each with its sum and highest level, are run over once more.
    """
    size = F.col(delta).cast("bigint")
    allocated = F.when(size > 0, size)
    level = F.sum(size).over(Window.partitionBy(scope, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    blocks = (
        events.withColumn("_block", block_of(events, t))
        .withColumn("_level", level)
        .groupBy(scope, "_block")
        .agg(
            F.sum(size).alias("_sum"),
            F.max("_level").alias("_high"),
            F.sum(allocated).alias("_total"),
            F.max(allocated).alias("_max"),
            F.count(allocated).alias("_alloc"),
            F.count(F.when(size < 0, size)).alias("_dealloc"),
        )
    )
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(scope).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        blocks.withColumn("_reached", before + F.col("_high"))
        .groupBy(scope)
        .agg(
            F.sum("_sum").cast("bigint").alias("current"),
            F.greatest(F.lit(0), F.max("_reached")).cast("bigint").alias("peak"),
            F.coalesce(F.sum("_total"), F.lit(0)).cast("bigint").alias("total"),
            F.coalesce(F.max("_max"), F.lit(0)).cast("bigint").alias("max"),
            F.sum("_alloc").alias("n_alloc"),
            F.sum("_dealloc").alias("n_dealloc"),
        )
    )


def add_subscope(parent: dict, child: dict) -> dict:
    """A nested scope's record folded into its parent's: its peak stood on what the parent held."""
    return {
        "current": parent["current"] + child["current"],
        "peak": max(parent["peak"], parent["current"] + child["peak"]),
        "total": parent["total"] + child["total"],
        "max": max(parent["max"], child["max"]),
        "n_alloc": parent["n_alloc"] + child["n_alloc"],
        "n_dealloc": parent["n_dealloc"] + child["n_dealloc"],
    }


def add_scopes(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records of scopes side by side, as of several calls: sums, but for the greatest peak and allocation."""
    return records.groupBy(*(by or [])).agg(
        F.sum("current").cast("bigint").alias("current"),
        F.max("peak").alias("peak"),
        F.sum("total").cast("bigint").alias("total"),
        F.max("max").alias("max"),
        F.sum("n_alloc").cast("bigint").alias("n_alloc"),
        F.sum("n_dealloc").cast("bigint").alias("n_dealloc"),
    )


def add_subscope_columns(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Row by row the same as :func:`add_subscope`, for records that share a key."""
    p, c = parent.alias("p"), child.alias("c")
    zero = F.lit(0).cast("bigint")

    def own(name):
        return F.coalesce(F.col(f"c.{name}"), zero)

    return p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "left").select(
        F.col(f"p.{key}").alias(key),
        (F.col("p.current") + own("current")).alias("current"),
        F.greatest(F.col("p.peak"), F.col("p.current") + own("peak")).alias("peak"),
        (F.col("p.total") + own("total")).alias("total"),
        F.greatest(F.col("p.max"), own("max")).alias("max"),
    )
