"""Leaf operators: messages with sequence numbers into and out of a pipeline, traces and topologies from files."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY_SAMPLES = "timestamp double, free_memory_bytes bigint, total_memory_bytes bigint, used_memory_bytes bigint"
TOPOLOGY = (
    "system struct<hostname: string, num_gpus: int, num_numa_nodes: int, num_network_devices: int>, "
    "gpus array<struct<id: int, name: string, pci_bus_id: string, uuid: string, numa_node: int, cpu_affinity: struct<cpulist: string, cores: array<int>>, memory_affinity: array<int>, network_devices: array<string>>>, "
    "network_devices array<struct<name: string, numa_node: int, pci_bus_id: string>>"
)


def push(spark: SparkSession, payloads: Iterable[Any], payload_type: str = "string", first: int = 0) -> DataFrame:
    """``seq, payload``: payloads in order, numbered from ``first``. A null payload is no message and is refused."""
    rows = []
    for k, p in enumerate(payloads):
        if p is None:
            raise ValueError(f"message {k} is empty")
        rows.append((first + k, p))
    return spark.createDataFrame(rows, f"seq bigint, payload {payload_type}")


def pull(df: DataFrame, seq: str = "seq") -> list:
    """All messages in the order of their numbers, on the driver: a pipeline's end for results known to be small."""
    return df.orderBy(seq).collect()


def checked_sequence(df: DataFrame, seq: str = "seq") -> bool:
    """Whether numbers are present and none comes twice, as a channel's must."""
    row = df.agg(F.count(F.lit(1)), F.count(seq), F.count_distinct(seq)).first()
    return row[0] == row[1] == row[2]


def memory_samples(spark: SparkSession, path: str) -> DataFrame:
    """Device memory samples as CSV with a header."""
    return spark.read.schema(MEMORY_SAMPLES).option("header", True).csv(path)


def memory_sample_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count(F.lit(1)).alias("n"), F.min("used_memory_bytes").alias("min_used"), F.max("used_memory_bytes").alias("max_used"), (F.max("timestamp") - F.min("timestamp")).alias("seconds"))


def topology(spark: SparkSession, path: str) -> DataFrame:
    """A machine's topology from its JSON description."""
    return spark.read.schema(TOPOLOGY).option("multiLine", True).json(path)


def device_neighbours(found: DataFrame) -> DataFrame:
    """``gpu, numa_node, network_device``: which network devices stand by which device."""
    gpus = found.select(F.explode("gpus").alias("g"))
    return gpus.select(F.col("g.id").alias("gpu"), F.col("g.numa_node").alias("numa_node"), F.explode_outer("g.network_devices").alias("network_device"))
