import operator

import pytest
from pyspark.sql import functions as F

from weftline.operators import chunks, collectives, pipeline


def recursive_doubling(values, op):
    """The exchange itself: remainder ranks pair up, then partners at distance 1, 2, 4, ... combine."""
    n = len(values)
    p = 1 << (n.bit_length() - 1)
    r = n - p
    slots = [op(values[2 * i], values[2 * i + 1]) if i < r else values[i + r] for i in range(p)]
    step = 1
    while step < p:
        slots = [op(slots[i & ~step], slots[i | step]) for i in range(p)]
        step *= 2
    return slots[0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_tree_fold(spark, n):
    values = [(7 * k * k + 3) % 50 for k in range(n)]
    rows = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "elem int, rank int, x int")
    got = collectives.all_reduce_tree(rows, "elem", "rank", "x", n, lambda a, b: a - b).first()["reduced"]
    assert got == recursive_doubling(values, operator.sub)


def test_tree_fold_needs_all_ranks(spark):
    rows = spark.createDataFrame([(0, 0, 5)], "elem int, rank int, x int")
    assert collectives.all_reduce_tree(rows, "elem", "rank", "x", 2, lambda a, b: a + b).first()["reduced"] is None


@pytest.mark.parametrize("n", [1, 3, 8])
@pytest.mark.parametrize("kind", ["int", "float", "double", "decimal(20,0)"])
def test_all_reduce_typed(spark, n, kind):
    value = (F.col("rank") + 1) * 100 + (F.col("j") + 1) * 10 + F.col("j")
    rows = spark.range(n).select(F.col("id").alias("rank")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("x", value.cast(kind))
    out = collectives.all_reduce(rows, "j", s=("x", "sum"), lo=("x", "min"), hi=("x", "max")).orderBy("j").collect()
    expected = [[(r + 1) * 100 + (j + 1) * 10 + j for r in range(n)] for j in range(8)]
    assert [(float(r["s"]), float(r["lo"]), float(r["hi"])) for r in out] == [(sum(e), min(e), max(e)) for e in expected]
    with pytest.raises(ValueError):
        collectives.all_reduce(rows, "j", s=("x", "median"))


@pytest.mark.parametrize("ranks", [1, 2, 5])
@pytest.mark.parametrize("inserts", [0, 1, 10])
def test_all_gather(spark, ranks, inserts):
    rows = spark.createDataFrame([(r, s) for r in range(ranks) for s in range(inserts)], "rank int, seq int")
    out = collectives.all_gather(rows).orderBy("sequence").collect()
    assert [(x["rank"], x["seq"]) for x in out] == [(r, s) for r in range(ranks) for s in range(inserts)]
    assert [x["sequence"] for x in out] == list(range(ranks * inserts))
    assert collectives.all_gather(rows, ordered=False).select("sequence").distinct().count() == ranks * inserts


def test_sparse(spark):
    rows = spark.createDataFrame([(0, 1, 5), (0, 1, 2), (1, 2, 1), (2, 1, 9)], "src int, dst int, seq int")
    out = collectives.sparse_all_to_all(rows, [(0, 1), (1, 2)], 3).orderBy("src", "ordinal").collect()
    assert [(x["src"], x["dst"], x["seq"], x["ordinal"]) for x in out] == [(0, 1, 2, 0), (0, 1, 5, 1), (1, 2, 1, 0)]
    assert collectives.sparse_all_to_all(rows, [], 3).count() == 0
    with pytest.raises(Exception, match="off the declared"):
        collectives.sparse_all_to_all(rows, [(0, 1)], 3, strict=True).collect()
    for edges, error in (([(0, 3)], IndexError), ([(1, 1)], IndexError), ([(0, 1), (0, 1)], ValueError)):
        with pytest.raises(error):
            collectives.check_edges(edges, 3)


def test_chunks(spark):
    rows = spark.createDataFrame([(0, 0, b"m", b"data"), (0, 1, None, None), (1, 0, b"m", b"")], "message int, pid int, m binary, d binary")
    packed = rows.select("message", "pid", chunks.packed(F.col("m"), F.col("d")).alias("chunk"))
    back = chunks.exploded(chunks.partition_map(packed, "pid", "chunk", ["message"]), "chunks")
    assert sorted((r["message"], r["pid"], bytes(r["chunk"]["data"])) for r in back.collect()) == [(0, 0, b"data"), (1, 0, b"")]
    with pytest.raises(Exception, match="without metadata"):
        spark.range(1).select(chunks.packed(F.lit(None), F.lit(b"x"))).collect()
    assert chunks.parse_tier("pinned-host") == "PINNED_HOST" and chunks.tiers_from("pinned") == ("PINNED_HOST", "HOST")
    with pytest.raises(ValueError):
        chunks.parse_tier("tape")


def test_fanout_and_linearise(spark):
    rows = spark.range(3000).select(F.col("id").alias("seq"))
    with pytest.raises(ValueError):
        pipeline.fanout(rows, 1)
    assert [f.count() for f in pipeline.fanout(rows, 4)] == [3000] * 4
    out = pipeline.linearise([rows.where(F.col("seq") % 10 == k) for k in range(10)])
    assert [r["seq"] for r in out.collect()] == list(range(3000))


def test_round_robin_order(spark):
    sizes = [3, 0, 5, 1]
    rows = [(p, s) for p, n in enumerate(sizes) for s in range(n)]
    out = pipeline.round_robin_order(spark.createDataFrame(rows, "producer int, seq int"), "producer", "seq").orderBy("position").collect()
    assert [(r["producer"], r["seq"]) for r in out] == sorted(rows, key=lambda r: (r[1], r[0]))


def test_totals_before(spark):
    rows = spark.createDataFrame([(k, k * k % 7) for k in range(0, 300, 3)], "k bigint, v bigint")
    out = pipeline.totals_before(rows, "k", "v", "before", block=10).orderBy("k").collect()
    assert [r["before"] for r in out] == [sum(j * j % 7 for j in range(0, k, 3)) for k in range(0, 300, 3)]


def test_actors(spark, tmp_path):
    with pytest.raises(TypeError):
        pipeline.define_actor(lambda: None)

    async def later(context):
        return None

    with pytest.raises(TypeError):
        pipeline.define_actor(later)
    context = pipeline.Context(spark)
    read = pipeline.define_actor(lambda context: context.spark.range(10).select(F.col("id").alias("seq")))
    double = pipeline.define_actor(lambda context, x: x.select((F.col("seq") * 2).alias("seq")))
    network = pipeline.Network(context).add("in", read).add("out", double, "in")
    assert network.run({"out": str(tmp_path / "out")}) == {"out": 10}
    with pytest.raises(KeyError):
        network.output("none")
    with pytest.raises(ValueError):
        network.add("in", read)
    loop = pipeline.Network(context).add("a", double, "b").add("b", double, "a")
    with pytest.raises(ValueError):
        loop.output("a")
    context.shutdown()
    context.shutdown()
    with pytest.raises(RuntimeError):
        read(context)
    with pytest.raises(ValueError):
        pipeline.throttled(spark.range(1), 0)
