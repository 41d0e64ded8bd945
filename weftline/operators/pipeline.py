"""Bounded pipelines: actors are functions between DataFrames, channels the edges of a lazily planned network."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.config import Options
from weftline.operators.running import numbered, totals_before
from weftline.operators.shuffle import shuffle


@dataclass
class Context:
    """What actors of a network share: the session, options, and a number for each channel."""

    spark: SparkSession
    options: Options = field(default_factory=Options)
    closed: bool = False
    _uid: int = 0

    def uid(self) -> int:
        self._uid += 1
        return self._uid - 1

    def shutdown(self) -> None:
        """May be called again."""
        self.closed = True


Actor = Callable[..., DataFrame]


def define_actor(f: Actor) -> Actor:
    """Marks a function ``(context, *inputs) -> DataFrame`` as an actor; anything else is refused at once."""
    if not callable(f) or inspect.iscoroutinefunction(f):
        raise TypeError("an actor is a plain function from DataFrames to a DataFrame")
    parameters = list(inspect.signature(f).parameters.values())
    if not parameters or parameters[0].kind not in (parameters[0].POSITIONAL_ONLY, parameters[0].POSITIONAL_OR_KEYWORD):
        raise TypeError("an actor's first argument is the context")

    def actor(context: Context, *inputs: DataFrame, **options) -> DataFrame:
        if not isinstance(context, Context):
            raise TypeError("an actor's first argument must be a Context")
        if context.closed:
            raise RuntimeError("the context is shut down")
        return f(context, *inputs, **options)

    actor.__name__, actor.__doc__ = f.__name__, f.__doc__
    return actor


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """A user-defined operator over Arrow batches: any number of rows out for each batch in."""
    return df.mapInArrow(f, schema)


class Network:
    """Actors by the name of the channel that each fills. Planning is lazy; nothing runs before a result is asked for."""

    def __init__(self, context: Context):
        self.context, self._actors = context, {}
        self._made: dict[str, DataFrame] = {}

    def add(self, channel: str, actor: Actor, *inputs: str, **options) -> Network:
        if channel in self._actors:
            raise ValueError(f"two actors fill {channel!r}")
        self._actors[channel] = (actor, inputs, options)
        return self

    def output(self, channel: str, _above: tuple[str, ...] = ()) -> DataFrame:
        if channel not in self._actors:
            raise KeyError(f"no actor fills {channel!r}")
        if channel in _above:
            raise ValueError(f"{channel!r} depends on itself")
        if channel not in self._made:
            actor, inputs, options = self._actors[channel]
            self._made[channel] = actor(self.context, *(self.output(i, (*_above, channel)) for i in inputs), **options)
        return self._made[channel]

    def run(self, sinks: Mapping[str, str]) -> dict[str, int]:
        """Writes the named channels as Parquet, all at once, and returns their row counts.

        The first error cancels what the other sinks still run; all errors are raised as a group.
        """
        spark = self.context.spark
        frames = {channel: self.output(channel) for channel in sinks}
        tag = f"network-{uuid.uuid4().hex}"

        def write(channel: str, path: str) -> int:
            spark.sparkContext.addJobTag(tag)
            frames[channel].write.mode("errorifexists").parquet(path)
            return spark.read.schema(frames[channel].schema).parquet(path).count()

        with ThreadPoolExecutor(max(1, len(sinks))) as pool:
            running = {channel: pool.submit(inheritable_thread_target(spark)(write), channel, path) for channel, path in sinks.items()}
            if any(f.exception() for f in wait(running.values(), return_when=FIRST_EXCEPTION).done):
                spark.sparkContext.cancelJobsWithTag(tag)
        errors = [e for f in running.values() if (e := f.exception())]
        if errors:
            raise ExceptionGroup(f"{len(errors)} of {len(sinks)} sinks failed", errors)
        return {channel: f.result() for channel, f in running.items()}


def fanout(df: DataFrame, outputs: int, bounded: bool = True) -> list[DataFrame]:
    """The same messages for each of at least two consumers.

    Frames never change, so outputs share one plan. Unbounded: the input is kept, so that consumers that run at
    different times read it once; the caller unpersists it.
    """
    if outputs < 2:
        raise ValueError("a fanout has at least two outputs")
    shared = df if bounded else df.persist()
    return [shared.select("*") for _ in range(outputs)]


def linearise(producers: Iterable[DataFrame], seq: str = "seq") -> DataFrame:
    """Messages of all producers in the order of their numbers."""
    frames = list(producers)
    if not frames:
        raise ValueError("nothing to linearise")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(seq)


def round_robin_order(df: DataFrame, producer: str, order: str) -> DataFrame:
    """Adds ``ordinal`` and ``position``: one message of each producer in turn, as queues are drained.

    A message's position is the number of messages before it: those of lower ordinal of all producers, counted from
    the producers' sizes, and those of its ordinal of earlier producers. No window goes over all rows, nor over all of
    a producer's: ordinals are counted by blocks. One window holds the messages of one ordinal, a row per producer.
    """
    rows = numbered(df, [producer], order, "ordinal")
    levels = totals_before(rows.groupBy("ordinal").agg(F.count(F.lit(1)).alias("_n")), "ordinal", "_n", "_before").drop("_n")
    within = F.row_number().over(Window.partitionBy("ordinal").orderBy(producer)).cast("bigint") - 1
    return rows.withColumn("_within", within).join(levels, "ordinal").withColumn("position", F.col("_before") + F.col("_within")).drop("_before", "_within")


def throttled(df: DataFrame, tickets: int, seq: str = "seq") -> DataFrame:
    """Adds ``wave``: with so many tickets, which messages are under way together."""
    if tickets <= 0:
        raise ValueError("at least one ticket is needed")
    return df.withColumn("wave", F.expr(f"{seq} div {int(tickets)}"))


def shuffler(df: DataFrame, pid: Column | str, total: int, payload: Column) -> DataFrame:
    """One message per partition, empty ones too: ``sequence`` (the partition id), ``n`` and the ``payloads``."""
    column = F.col(pid) if isinstance(pid, str) else pid
    placed = shuffle(df.select(column.alias("_pid"), payload.alias("_payload")), "_pid", total)
    grouped = placed.groupBy("_pid").agg(F.sort_array(F.collect_list("_payload")).alias("payloads"))
    ids = df.sparkSession.range(total).select(F.col("id").alias("sequence"))
    out = ids.join(grouped, F.col("sequence") == F.col("_pid"), "left").drop("_pid")
    return out.withColumn("n", F.coalesce(F.size("payloads"), F.lit(0)).cast("bigint"))
