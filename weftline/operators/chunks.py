"""The unit of data: metadata bytes with payload bytes, what tiers hold them, and maps of them by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Memory tiers in decreasing preference.
TIERS = ("DEVICE", "PINNED_HOST", "HOST")
SPILL_TARGETS = TIERS[1:]


def packed(metadata: Column, data: Column) -> Column:
    """``struct<metadata: binary, data: binary>``; payload without metadata is refused while the query runs."""
    meta, body = F.coalesce(metadata.cast("binary"), F.lit(b"")), F.coalesce(data.cast("binary"), F.lit(b""))
    ok = F.when((F.octet_length(meta) == 0) & (F.octet_length(body) > 0), F.raise_error(F.lit("payload without metadata")).cast("binary")).otherwise(meta)
    return F.struct(ok.alias("metadata"), body.alias("data"))


def is_empty(chunk: Column) -> Column:
    return (F.octet_length(chunk["metadata"]) == 0) & (F.octet_length(chunk["data"]) == 0)


def content_size(description: Column) -> Column:
    """Bytes over all tiers of ``struct<device, pinned_host, host, spillable>``."""
    return sum((description[t.lower()] for t in TIERS[1:]), description[TIERS[0].lower()])


def principal_tier(description: Column) -> Column:
    """The first tier, in order of preference, that holds any bytes; DEVICE where none does."""
    out = F.lit(TIERS[0])
    for t in reversed(TIERS):
        out = F.when(description[t.lower()] > 0, F.lit(t)).otherwise(out)
    return out


def parse_tier(text: str) -> str:
    """A tier's name in any case; PINNED and PINNED-HOST stand for PINNED_HOST."""
    name = text.strip().upper().replace("-", "_")
    name = "PINNED_HOST" if name == "PINNED" else name
    if name not in TIERS:
        raise ValueError(f"unknown memory tier {text!r}")
    return name


def tiers_from(tier: str) -> tuple[str, ...]:
    """The tier and all below it."""
    return TIERS[TIERS.index(parse_tier(tier)) :]


def partition_map(df: DataFrame, pid: str, chunk: str, keys: list[str] | None = None) -> DataFrame:
    """Chunks of each message as a map from partition id; equal ids within a message are refused by Spark."""
    grouped = df.groupBy(*(keys or []))
    return grouped.agg(F.map_from_entries(F.collect_list(F.struct(pid, chunk))).alias("chunks"))


def exploded(df: DataFrame, chunks: str, pid: str = "pid", chunk: str = "chunk") -> DataFrame:
    """The working form of a partition map: a row per chunk, empty ones left out."""
    rows = df.select(*(c for c in df.columns if c != chunks), F.explode(chunks).alias(pid, chunk))
    return rows.where(~is_empty(F.col(chunk)))
