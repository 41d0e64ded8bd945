"""Collective, pipeline and ownership queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import chunks, collectives, ownership, pipeline, shuffle
from weftline.sources.tables import table

N, P = 4, 8


def _events(spark, sf_dir, *extra):
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), (F.col("user_id") % N).alias("rank"), "user_id", "event_type", "value", "props", *extra)


def local_partitions(spark, sf_dir):
    return ownership.local_partitions(spark, 100, 7, owner="contiguous")


def chunk_indices(spark, sf_dir):
    return ownership.chunk_indices(spark, 100, 16)


def shuffle_placement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % P).cast("int").alias("pid"))
    placed = shuffle.shuffle(rows, "pid", P).withColumn("partition", F.spark_partition_id().cast("bigint"))
    return placed.groupBy("pid", "partition").agg(F.count(F.lit(1)).alias("n")).withColumn("pid", F.col("pid").cast("bigint"))


def shuffle_conservation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).cast("int").alias("pid"), "o_orderkey")
    before = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n_in"), F.sum("o_orderkey").alias("key_sum_in"))
    after = shuffle.shuffle(rows, "pid", 10).groupBy("pid").agg(F.count(F.lit(1)).alias("n_out"), F.sum("o_orderkey").alias("key_sum_out"))
    return before.join(after, "pid").withColumn("pid", F.col("pid").cast("bigint"))


def shuffle_payload_stats(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("rank").alias("src"), (F.col("seq") % N).alias("dst"), F.octet_length("props").alias("nbytes"))
    return shuffle.payload_stats(rows, "src", "dst", "nbytes")


def range_shuffle_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    ranged = shuffle.range_shuffle(rows, 4, "o_orderkey").withColumn("partition", F.spark_partition_id())
    ends = ranged.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    # A row per partition.
    ends = ends.withColumn("next_low", F.lead("low").over(Window.orderBy("partition")))
    return ends.agg(F.coalesce(F.sum((F.col("high") > F.col("next_low")).cast("bigint")), F.lit(0)).alias("out_of_order"), F.sum("n").alias("n"))


def partition_vector_with_empties(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 7).alias("pid"))
    return shuffle.partition_totals(rows, "pid", 20, F.count(F.lit(1)).alias("n")).withColumn("n", F.coalesce("n", F.lit(0)))


def shuffler_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 2).alias("pid"), F.col("n_nationkey").cast("bigint").alias("key"))
    return pipeline.shuffler(rows, "pid", 12, F.col("key")).select("sequence", "n", F.array_join("payloads", ",").alias("payloads"))


def all_gather_ordered(spark, sf_dir):
    return collectives.all_gather(_events(spark, sf_dir)).select("rank", "seq", "sequence")


def all_gather_unordered(spark, sf_dir):
    out = collectives.all_gather(_events(spark, sf_dir), ordered=False)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence").alias("numbers"), F.sum("seq").alias("seq_sum"))


def all_gather_ragged(spark, sf_dir):
    rows = spark.range(5).select(F.col("id").alias("rank")).withColumn("seq", F.explode(F.when(F.col("rank") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("rank") - 1))))
    return collectives.all_gather(rows).select("rank", "seq", "sequence")


def all_gather_replicated(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"))
    return collectives.replicate(rows, 3).groupBy(F.col("dst").cast("bigint").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("key_sum"))


def _reduced(op):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("elem_idx"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
        out = collectives.all_reduce(rows, "elem_idx", reduced=("q", op))
        return out.withColumn("reduced", F.col("reduced").cast("double"))

    return query


def all_reduce_struct(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("elem_idx"), "event_id", "user_id")
    return collectives.all_reduce(rows, "elem_idx", value=("event_id", "sum"), weight=("user_id", "min"))


def all_reduce_product(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("elem_idx"), (F.col("n_nationkey") + 1).cast("double").alias("x"))
    return collectives.all_reduce(rows, "elem_idx", reduced=("x", "product"))


def _tree(n):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "events").select((F.col("user_id") % 11).alias("elem_idx"), (F.col("event_id") % n).alias("rank"), "event_id")
        per_rank = rows.groupBy("elem_idx", "rank").agg(F.sum("event_id").alias("x"))
        return collectives.all_reduce_tree(per_rank, "elem_idx", "rank", "x", n, lambda a, b: a - b)

    return query


def _tree_sql(n, shape):
    ranks = ", ".join(f"max(CASE WHEN rank = {k} THEN x END) AS a{k}" for k in range(n))
    return f"""WITH r AS (SELECT user_id % 11 AS elem_idx, event_id % {n} AS rank, CAST(sum(event_id) AS BIGINT) AS x FROM events GROUP BY 1, 2),
        w AS (SELECT elem_idx, {ranks} FROM r GROUP BY 1) SELECT elem_idx, {shape} AS reduced FROM w"""


def _sparse(edges):
    def query(spark, sf_dir):
        rows = _events(spark, sf_dir).select(F.col("rank").alias("src"), (F.col("seq") % N).alias("dst"), "seq")
        return collectives.sparse_all_to_all(rows, edges, N)

    return query


def _sparse_sql(edges):
    listed = ", ".join(f"({s}, {d})" for s, d in edges)
    return f"""WITH m AS (SELECT user_id % {N} AS src, event_id % {N} AS dst, event_id AS seq FROM events)
        SELECT src, dst, seq, row_number() OVER (PARTITION BY src, dst ORDER BY seq) - 1 AS ordinal FROM m WHERE (src, dst) IN ({listed})"""


RING = [(k, (k + 1) % N) for k in range(N)]
ASYMMETRIC = [(0, 1), (0, 2), (1, 2), (2, 0)]


def fanout_two_consumers(spark, sf_dir):
    context = pipeline.Context(spark)

    @pipeline.define_actor
    def read(context):
        return _events(context.spark, sf_dir).select("seq", "event_type", "value")

    @pipeline.define_actor
    def merge(context, messages):
        one, other = pipeline.fanout(messages, 2)
        counts = one.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(other.groupBy("event_type").agg(F.max("seq").alias("last")), "event_type")

    return pipeline.Network(context).add("messages", read).add("out", merge, "messages").output("out")


def linearise_round_robin(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("producer"), "seq")
    return pipeline.round_robin_order(rows, "producer", "seq")


def linearise_sequences(spark, sf_dir):
    rows = _events(spark, sf_dir).select("seq", "rank")
    return pipeline.linearise([rows.where(F.col("rank") == k) for k in range(N)])


def throttle_waves(spark, sf_dir):
    return pipeline.throttled(_events(spark, sf_dir), 64).groupBy("wave").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def user_actor_batches(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(b.column(1)).cast(pa.int64())], ["seq", "nbytes"])

    return pipeline.map_batches(_events(spark, sf_dir).select("seq", "props"), lengths, "seq bigint, nbytes bigint")


def packed_chunks(spark, sf_dir):
    rows = _events(spark, sf_dir).select((F.col("seq") % P).alias("pid"), chunks.packed(F.col("event_type"), F.col("props")).alias("chunk"))
    kept = rows.where(~chunks.is_empty(F.col("chunk")))
    return kept.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("chunk.metadata")).alias("metadata_bytes"), F.sum(F.octet_length("chunk.data")).alias("data_bytes"))


def partition_map_round_trip(spark, sf_dir):
    rows = _events(spark, sf_dir).select((F.col("seq") - F.col("seq") % P).alias("message"), (F.col("seq") % P).alias("pid"), chunks.packed(F.lit("m"), F.col("event_type")).alias("chunk"))
    back = chunks.exploded(chunks.partition_map(rows, "pid", "chunk", ["message"]), "chunks")
    return back.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("chunk.data")).alias("data_bytes"))


def principal_tiers(spark, sf_dir):
    size = F.octet_length("props").cast("bigint")
    held = F.struct(F.when(F.col("event_id") % 3 == 0, size).otherwise(0).alias("device"), F.when(F.col("event_id") % 2 == 0, size).otherwise(0).alias("pinned_host"), size.alias("host"), F.lit(True).alias("spillable"))
    rows = table(spark, sf_dir, "events").select(held.alias("d"))
    return rows.groupBy(chunks.principal_tier(F.col("d")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(chunks.content_size(F.col("d"))).alias("nbytes"))


def shuffle_join(spark, sf_dir):
    """Both sides dealt to the same exact partitions, then joined there: one exchange a side."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % P).cast("int").alias("pid"), "l_orderkey", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % P).cast("int").alias("pid"), F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    # Both sides lie where the join wants them; hashing one side within a partition needs no exchange and no sort.
    joined = shuffle.shuffle(items, "pid", P).join(shuffle.shuffle(orders, "pid", P).hint("shuffle_hash"), ["pid", "l_orderkey"])
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("q").cast("double").alias("quantity"))


def broadcast_join_allgather(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Nations are a fixed set of 25 rows at any scale.
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def range_sort_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


QUERIES = {
    f.__name__: f
    for f in (
        local_partitions, chunk_indices, shuffle_placement, shuffle_conservation, shuffle_payload_stats, range_shuffle_ranks,
        partition_vector_with_empties, shuffler_messages, all_gather_ordered, all_gather_unordered, all_gather_ragged, all_gather_replicated,
        all_reduce_struct, all_reduce_product, fanout_two_consumers, linearise_round_robin, linearise_sequences, throttle_waves, user_actor_batches,
        packed_chunks, partition_map_round_trip, principal_tiers, shuffle_join, broadcast_join_allgather, range_sort_topk,
    )
} | {f"all_reduce_{op}": _reduced(op) for op in ("sum", "min", "max")} | {"all_reduce_tree_4": _tree(4), "all_reduce_tree_5": _tree(5), "sparse_alltoall_ring": _sparse(RING), "sparse_alltoall_asymmetric": _sparse(ASYMMETRIC)}

_EVENTS = f"(SELECT event_id AS seq, user_id % {N} AS rank, user_id, event_type, value, props FROM events)"
ORACLES = {
    "local_partitions": "SELECT range AS pid, (range * 7) // 100 AS rank FROM range(100)",
    "chunk_indices": "SELECT range AS chunk, least(range * 7, 100) AS begin, least((range + 1) * 7, 100) AS \"end\" FROM range(16)",
    "shuffle_placement": f"SELECT l_orderkey % {P} AS pid, l_orderkey % {P} AS partition, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "shuffle_conservation": "SELECT o_orderkey % 10 AS pid, count(*) AS n_in, CAST(sum(o_orderkey) AS BIGINT) AS key_sum_in, count(*) AS n_out, CAST(sum(o_orderkey) AS BIGINT) AS key_sum_out FROM orders GROUP BY 1",
    "shuffle_payload_stats": f"SELECT rank AS src, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS total_bytes, max(strlen(props)) AS max_bytes FROM {_EVENTS} WHERE rank <> seq % {N} AND strlen(props) > 0 GROUP BY 1",
    "range_shuffle_ranks": "SELECT CAST(0 AS BIGINT) AS out_of_order, count(*) AS n FROM orders",
    "partition_vector_with_empties": "SELECT r.range AS pid, count(event_id) AS n FROM range(20) r LEFT JOIN events ON event_id % 7 = r.range GROUP BY 1",
    "shuffler_messages": "SELECT r.range AS sequence, count(n_nationkey) AS n, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS payloads FROM range(12) r LEFT JOIN nation ON n_regionkey * 2 = r.range GROUP BY 1",
    "all_gather_ordered": f"SELECT rank, seq, row_number() OVER (ORDER BY rank, seq) - 1 AS sequence FROM {_EVENTS}",
    "all_gather_unordered": "SELECT count(*) AS n, count(*) AS numbers, CAST(sum(event_id) AS BIGINT) AS seq_sum FROM events",
    "all_gather_ragged": "SELECT a.range AS rank, b.range AS seq, row_number() OVER (ORDER BY a.range, b.range) - 1 AS sequence FROM range(5) a, range(5) b WHERE b.range < a.range",
    "all_gather_replicated": "SELECT d.range AS dst, count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS key_sum FROM range(3) d, region GROUP BY 1",
    "all_reduce_struct": "SELECT user_id % 5 AS elem_idx, CAST(sum(event_id) AS BIGINT) AS value, min(user_id) AS weight FROM events GROUP BY 1",
    "all_reduce_product": "SELECT n_nationkey % 5 AS elem_idx, product(CAST(n_nationkey + 1 AS DOUBLE)) AS reduced FROM nation GROUP BY 1",
    "fanout_two_consumers": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1",
    "linearise_round_robin": "WITH m AS (SELECT user_id AS producer, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal FROM events) SELECT producer, seq, ordinal, row_number() OVER (ORDER BY ordinal, producer) - 1 AS position FROM m",
    "linearise_sequences": f"SELECT seq, rank FROM {_EVENTS} ORDER BY seq",
    "throttle_waves": "SELECT event_id // 64 AS wave, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
    "user_actor_batches": "SELECT event_id AS seq, strlen(props) AS nbytes FROM events",
    "packed_chunks": f"SELECT event_id % {P} AS pid, count(*) AS n, CAST(sum(strlen(event_type)) AS BIGINT) AS metadata_bytes, CAST(sum(strlen(props)) AS BIGINT) AS data_bytes FROM events GROUP BY 1",
    "partition_map_round_trip": f"SELECT event_id % {P} AS pid, count(*) AS n, CAST(sum(strlen(event_type)) AS BIGINT) AS data_bytes FROM events GROUP BY 1",
    "principal_tiers": "SELECT CASE WHEN event_id % 3 = 0 AND strlen(props) > 0 THEN 'DEVICE' WHEN event_id % 2 = 0 AND strlen(props) > 0 THEN 'PINNED_HOST' WHEN strlen(props) > 0 THEN 'HOST' ELSE 'DEVICE' END AS tier, count(*) AS n, CAST(sum(strlen(props) * (1 + CAST(event_id % 3 = 0 AS INT) + CAST(event_id % 2 = 0 AS INT))) AS BIGINT) AS nbytes FROM events GROUP BY 1",
    "shuffle_join": "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "broadcast_join_allgather": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "range_sort_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "all_reduce_tree_4": _tree_sql(4, "(a0 - a1) - (a2 - a3)"),
    "all_reduce_tree_5": _tree_sql(5, "((a0 - a1) - a2) - (a3 - a4)"),
    "sparse_alltoall_ring": _sparse_sql(RING),
    "sparse_alltoall_asymmetric": _sparse_sql(ASYMMETRIC),
} | {f"all_reduce_{op}": f"SELECT l_linenumber AS elem_idx, CAST({op}(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS reduced FROM lineitem GROUP BY 1" for op in ("sum", "min", "max")}
