"""Running totals and numbers by blocks, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

BLOCK_ROWS = 1 << 16


def block_of(df: DataFrame, key: str, rows: int = BLOCK_ROWS) -> Column:
    """A block's number for each ``key``: ranges of whole numbers that hold about ``rows`` rows where they are spread evenly.

    Of a struct the first field counts; keys that aren't whole numbers are one block.
    """
    kind, leading = df.schema[key].dataType, F.col(key)
    if isinstance(kind, StructType):
        kind, leading = kind[0].dataType, leading[kind[0].name]
    if not isinstance(kind, IntegralType):
        return F.lit(0).cast("bigint")
    low, high, n = df.agg(F.min(leading), F.max(leading), F.count(F.lit(1))).first()
    if low is None:
        return F.lit(0).cast("bigint")
    width = max(1, -(-(high - low + 1) * rows // n))
    return F.floor((leading.cast("bigint") - F.lit(low)) / F.lit(width)).cast("bigint")


def totals_before(df: DataFrame, key: str, value: str, name: str, block: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows (of equal ``by``) with a smaller ``key`` (whole numbers; among equal ones any order).

    Keys are summed by blocks of ``block`` keys, or of so many that a block has some ten thousand rows; only a group's
    block sums are run over in one task, then each block by itself.
    """
    by = by or []
    number = block_of(df, key) if block is None else F.floor(F.col(key) / block)
    rows = df.withColumn("_block", number)
    sums = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_block").alias("_of"), earlier.alias("_earlier"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_block").eqNullSafe(F.col("_of"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = rows.withColumn("_own", own).join(sums, same).withColumn(name, (F.col("_earlier") + F.col("_own")).cast("bigint"))
    return out.drop("_block", "_own", "_earlier", "_of", *(f"_by{i}" for i in range(len(by))))


def numbered(df: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """Adds each row's number from 0 within its group, in the order of ``key``."""
    return totals_before(df.withColumn("_one", F.lit(1)), key, "_one", name, by=by).drop("_one")
