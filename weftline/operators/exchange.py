"""Object forms of the collectives, for code that inserts piece by piece and extracts later.

An exchange gathers frames until ``insert_finished``; extraction then plans one shuffle over their union. Frames stay
lazy throughout: ``wait`` runs the exchange and keeps its result in the storage level asked for.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import collectives, shuffle
from weftline.operators.ownership import Owner, local_partitions

# Ranges of operation ids and stages, and of sequence numbers within a rank.
OPERATIONS, STAGES, SEQUENCE_BITS = 1 << 20, 1 << 3, 38


def tag(operation: int, stage: int) -> int:
    """One number for an operation and its stage; out of range raises."""
    if not 0 <= operation < OPERATIONS or not 0 <= stage < STAGES:
        raise OverflowError(f"operation {operation} or stage {stage} out of range")
    return operation << 3 | stage


def chunk_id(rank: int, sequence: int) -> int:
    """Rank and sequence number in one 64-bit number, rank first."""
    if not 0 <= sequence < 1 << SEQUENCE_BITS or not 0 <= rank < 1 << (64 - SEQUENCE_BITS):
        raise OverflowError("rank or sequence number out of range")
    return rank << SEQUENCE_BITS | sequence


def split_chunk_id(value: int) -> tuple[int, int]:
    return value >> SEQUENCE_BITS, value & ((1 << SEQUENCE_BITS) - 1)


class Exchange:
    """What all exchanges share: insertion up to a single finish, one extraction plan, an idempotent close."""

    def __init__(self, finished_callback: Callable[[], None] | None = None, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self._frames: list[DataFrame] = []
        self._done = self._closed = False
        self._callback, self._level = finished_callback, level
        self._result: DataFrame | None = None
        self._kept = False

    def _insert(self, frame: DataFrame) -> None:
        if self._done:
            raise RuntimeError("insertion after insert_finished")
        if self._closed:
            raise RuntimeError("the exchange is closed")
        self._frames.append(frame)

    def insert_finished(self) -> None:
        if self._done:
            raise RuntimeError("insert_finished was called before")
        self._done = True

    def finished(self) -> bool:
        return self._done and self._kept

    def _plan(self, make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        if not self._done:
            raise RuntimeError("extraction before insert_finished")
        if self._result is None and self._frames:
            union = self._frames[0]
            for f in self._frames[1:]:
                union = union.unionByName(f)
            self._result = make(union)
        return self._result

    def _keep(self, result: DataFrame | None, timeout: float | None) -> None:
        """Runs the exchange. A timeout that passes cancels its jobs, by their tag, and raises."""
        began = time.monotonic()
        if result is not None and not self._kept:
            result.persist(self._level)
            context, tag = result.sparkSession.sparkContext, f"exchange-{uuid.uuid4().hex}"
            timer = None if timeout is None else threading.Timer(timeout, context.cancelJobsWithTag, [tag])
            context.addJobTag(tag)
            try:
                if timer:
                    timer.start()
                result.write.format("noop").mode("overwrite").save()
            except Exception as e:
                if timeout is not None and time.monotonic() - began >= timeout:
                    raise TimeoutError(f"the exchange was cut short after {timeout} s") from e
                raise
            finally:
                context.removeJobTag(tag)
                if timer:
                    timer.cancel()
        if not self._kept:
            self._kept = True
            if self._callback:
                self._callback()
        if timeout is not None and time.monotonic() - began > timeout:
            raise TimeoutError(f"the exchange took longer than {timeout} s")

    def close(self) -> None:
        """Gives up what is kept; may be called again."""
        if self._result is not None and self._kept:
            self._result.unpersist()
        self._frames, self._closed = [], True


class Shuffler(Exchange):
    """Rows by exact partition id. Extraction of a partition gives its rows in no order; an empty one gives none."""

    def __init__(self, total: int, pid: str = "pid", nranks: int = 1, owner: str | Owner = "round_robin", **options):
        super().__init__(**options)
        if total <= 0:
            raise ValueError("total must be positive")
        self.total, self.pid, self.nranks, self.owner = total, pid, nranks, owner

    def insert(self, chunks: DataFrame, payload: str | None = None) -> None:
        """Rows with their partition id; rows whose ``payload`` is empty are left out."""
        self._insert(chunks if payload is None else chunks.where(F.octet_length(payload) > 0))

    def _shuffled(self) -> DataFrame | None:
        return self._plan(lambda union: shuffle.shuffle(union.withColumn(self.pid, F.col(self.pid).cast("int")), self.pid, self.total))

    def wait(self, timeout: float | None = None) -> None:
        self._keep(self._shuffled(), timeout)

    def extract(self, pid: int) -> DataFrame | None:
        """None where nothing was ever inserted."""
        if not 0 <= pid < self.total:
            raise IndexError(f"partition {pid} is outside [0, {self.total})")
        found = self._shuffled()
        return None if found is None else shuffle.extract(found, self.pid, pid)

    def extract_all(self) -> DataFrame | None:
        return self._shuffled()

    def local_partitions(self, spark, rank: int) -> list[int]:
        return [r["pid"] for r in local_partitions(spark, self.total, self.nranks, rank, self.owner).orderBy("pid").collect()]


class AllGather(Exchange):
    """Every rank's insertions for all ranks."""

    def insert(self, rank: int, sequence: int, frame: DataFrame) -> None:
        chunk_id(rank, sequence)
        self._insert(frame.withColumn("rank", F.lit(rank)).withColumn("seq", F.lit(sequence).cast("bigint")))

    def wait_and_extract(self, ordered: bool = True, timeout: float | None = None) -> DataFrame | None:
        """Rows with rank, insertion number and ``sequence``; rows of one insertion stay together, in their order as they lie."""
        found = self._plan(lambda union: union.withColumn("_row", F.monotonically_increasing_id()))
        self._keep(found, timeout)
        if found is None:
            return None
        if not ordered:
            return collectives.all_gather(found, ordered=False).drop("_row")
        keyed = found.withColumn("_seq", F.struct("seq", "_row"))
        return collectives.all_gather(keyed, "rank", "_seq").drop("_row", "_seq")


class SparseAllToAll(Exchange):
    """Messages along declared edges; a receiver reads each source's messages in the order they were sent."""

    def __init__(self, edges: Iterable[tuple[int, int]], nranks: int, **options):
        super().__init__(**options)
        self.edges, self.nranks = collectives.check_edges(edges, nranks), nranks
        self._sent: dict[tuple[int, int], int] = {}

    def insert(self, src: int, dst: int, message: DataFrame) -> None:
        if (src, dst) not in self.edges:
            raise RuntimeError(f"no edge leads from {src} to {dst}")
        n = self._sent[src, dst] = self._sent.get((src, dst), -1) + 1
        self._insert(message.withColumn("src", F.lit(src)).withColumn("dst", F.lit(dst)).withColumn("seq", F.lit(n).cast("bigint")))

    def wait(self, timeout: float | None = None) -> None:
        self._keep(self._plan(lambda union: union.repartition("dst", "src")), timeout)

    def extract(self, dst: int, src: int) -> DataFrame | None:
        """What ``src`` sent to ``dst``, by message; before :meth:`wait` it raises."""
        if (src, dst) not in self.edges:
            raise RuntimeError(f"no edge leads from {src} to {dst}")
        if not self._kept:
            raise RuntimeError("extraction before the exchange is complete")
        found = self._result
        return None if found is None else found.where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("seq")
