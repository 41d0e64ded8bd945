"""What the operators share: reading tables, the shared folder, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []
#: Folders of the scratch() that is under way.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: Spark's own switch: shuffle files go when the query that wrote them ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A path in the shared folder; within a scratch() what is written there goes at its end, unless it ``outlives`` that."""
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    made = _SCRATCH.get()
    if made is not None and not outlives:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written within are removed at the end. What is returned must be written with ``outlives``, as plans are lazy."""
    made: list[str] = []
    before = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE[:] = [x for x in _MADE if x[1] != path]


@atexit.register
def _remove_all() -> None:
    for spark, path in list(_MADE):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def written(df: DataFrame, name: str, outlives: bool = False) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors. Its shuffle files go with it."""
    spark = df.sparkSession
    path = new_folder(spark, name, outlives)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


class Shared:
    """A broadcast value whose class the executors need not know: it travels as bytes, classes and all."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self.bytes.value)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges`` (columns ``u``, ``v``, once each) hangs below one other, below which alone others hang: no round changes such edges."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max(F.col("up") + F.col("down"))).first()[0] in (None, 1)


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``u``, ``v``): the least node that can be reached.

    Alternating large-star and small-star rounds, a union-find whose parents are rows: each round hangs every node's
    neighbours below the least of them, until each node hangs directly below its root. A node's least neighbour is a
    partial aggregate, so a hub's edges never meet in one task but for the join, which adaptive execution splits.
    Every round ends as a table in the shared folder; stars need none. Nodes of self-loops only are kept.
    """
    spark = edges.sparkSession
    nodes = F.col("u") != F.col("v")
    now, path = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    loops = now.where(~nodes).select("u", F.col("v"))
    now, first = now.where(nodes), path
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(nodes)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        then, done = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        if path != first:
            remove(spark, path)
        now, path = then, done
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    rows = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = rows.select(F.col("component").alias("node"), "component")
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rows.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
