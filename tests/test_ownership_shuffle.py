import pytest
from pyspark.sql import functions as F

from weftline.operators import ownership, shuffle


@pytest.mark.parametrize("total", [1, 2, 3, 5, 7, 10, 16, 100])
@pytest.mark.parametrize("nranks", [1, 2, 3, 4, 5, 8])
def test_owners(spark, total, nranks):
    rows = ownership.local_partitions(spark, total, nranks, owner="contiguous").orderBy("pid").collect()
    ranks = [r["rank"] for r in rows]
    assert [r["pid"] for r in rows] == list(range(total))
    assert ranks == sorted(ranks) == [p * nranks // total for p in range(total)]
    turns = ownership.local_partitions(spark, total, nranks).orderBy("pid").collect()
    assert [r["rank"] for r in turns] == [p % nranks for p in range(total)]


def test_a_rank_may_own_nothing(spark):
    assert ownership.local_partitions(spark, 2, 5, rank=4).count() == 0
    with pytest.raises(ValueError):
        ownership.local_partitions(spark, 2, 5, rank=5)
    with pytest.raises(ValueError):
        ownership.resolve("nobody")


@pytest.mark.parametrize(("count", "k"), [(0, 3), (9, 4), (100, 16), (100, 1), (3, 5)])
def test_chunk_indices(spark, count, k):
    step = -(-count // k)
    rows = [tuple(r) for r in ownership.chunk_indices(spark, count, k).orderBy("chunk").collect()]
    assert rows == [(i, min(i * step, count), min((i + 1) * step, count)) for i in range(k)]


@pytest.mark.parametrize("total", [1, 2, 5, 10])
@pytest.mark.parametrize("count", [1, 9, 1000])
def test_round_trip(spark, total, count):
    rows = spark.range(count).select("id", (F.col("id") % total).alias("pid"))
    placed = shuffle.shuffle(rows, "pid", total).withColumn("at", F.spark_partition_id())
    assert placed.where("at <> pid").count() == 0
    assert sorted(r["id"] for r in placed.collect()) == list(range(count))
    assert shuffle.extract(placed, "pid", total + 1).count() == 0


def test_one_exchange(spark):
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("pid"))
    plan = shuffle.shuffle(rows, "pid", 4).groupBy("pid").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_bad_ids_raise(spark):
    for bad in (None, -1, 4):
        rows = spark.createDataFrame([(bad,)], "pid int")
        with pytest.raises(Exception, match="partition id"):
            shuffle.shuffle(rows, "pid", 4).collect()


def test_empty_payloads_are_skipped(spark):
    rows = spark.createDataFrame([(0, b""), (1, b"x"), (1, None)], "pid int, data binary")
    assert shuffle.shuffle(rows, "pid", 2, payload=F.col("data")).count() == 1
    totals = shuffle.partition_totals(rows.where("false"), "pid", 3, F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in totals.orderBy("pid").collect()] == [(0, None), (1, None), (2, None)]


def test_range_shuffle_is_sorted(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    ranged = shuffle.range_shuffle(rows, 4, "k")
    assert [r["k"] for r in ranged.collect()] == list(range(1000))


def test_payload_stats(spark):
    n = 5
    rows = spark.createDataFrame([(s, d, 28) for s in range(n) for d in range(n)], "src int, dst int, nbytes int")
    out = shuffle.payload_stats(rows, "src", "dst", "nbytes").collect()
    assert len(out) == n and all((r["n"], r["total_bytes"], r["max_bytes"]) == (n - 1, 28 * (n - 1), 28) for r in out)
    assert shuffle.payload_stats(rows.where("src = dst"), "src", "dst", "nbytes").count() == 0
