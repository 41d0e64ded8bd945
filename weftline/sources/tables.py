"""Sources: the driver's parquet tables, and ordered messages as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows given in the program, as literals of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    if not rows:
        return spark.createDataFrame([], schema)
    structs = [F.struct(*(F.lit(x).cast(k).alias(n) for x, k, n in zip(row, kinds, names, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
