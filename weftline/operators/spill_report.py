"""Analysis of a spill trace: events whose name is inline or an id into a table of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named_events(events: DataFrame, strings: DataFrame) -> DataFrame:
    """``name, start, end, payload``: inline names as they are, others looked up; events without a name are left out."""
    inline = events.where(F.col("text").isNotNull()).select(F.col("text").alias("name"), "start", "end", "payload")
    looked_up = events.where(F.col("text").isNull()).join(strings, F.col("text_id") == F.col("id")).select(F.col("value").alias("name"), "start", "end", "payload")
    return inline.unionByName(looked_up).where(F.col("name").isNotNull())


def analyze(events: DataFrame, strings: DataFrame, requested: str, spilled: str) -> DataFrame:
    """``metric, n, avg, std, min, max, total`` of durations, of bytes requested and of bytes spilled.

    ``requested`` names the events of spills (their payload is the amount asked for), ``spilled`` those that carry the
    amount gained. Durations count from nanoseconds. The deviation is the sample's, null for one event.
    """
    named = named_events(events, strings)
    metric = F.expr("stack(2, 'duration', cast(end - start as bigint), 'requested', payload) as (metric, x)")
    asked = named.where(F.col("name") == requested).select(metric)
    gained = named.where(F.col("name") == spilled).select(F.lit("spilled").alias("metric"), F.col("payload").alias("x"))
    return asked.unionByName(gained).where(F.col("x").isNotNull()).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("x").cast("double") / F.count(F.lit(1))).alias("avg"),
        F.stddev_samp("x").alias("std"),
        F.min("x").cast("bigint").alias("min"),
        F.max("x").cast("bigint").alias("max"),
        F.sum("x").cast("bigint").alias("total"),
    )


def ratios(metrics: DataFrame) -> DataFrame:
    """``satisfaction_pct`` (spilled of requested) and ``bytes_per_second``; null where the divisor is 0 or missing."""

    def total(name: str):
        return F.max(F.when(F.col("metric") == name, F.col("total")))

    return metrics.agg(total("spilled").alias("s"), total("requested").alias("r"), total("duration").alias("d")).select(
        F.when(F.col("r") > 0, 100.0 * F.col("s") / F.col("r")).alias("satisfaction_pct"),
        F.when(F.col("d") > 0, F.col("s") / (F.col("d") / 1e9)).alias("bytes_per_second"),
    )
