"""Ownership and shuffle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import ownership, shuffle
from weftline.sources.tables import table

P, RANKS = 8, 3


def _dealt(owner):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % P).cast("int").alias("pid"), "l_quantity", "l_extendedprice")
        dealt = shuffle.owned(shuffle.shuffle(rows, "pid", P), "pid", RANKS, P, owner)
        return dealt.groupBy(F.col("pid"), F.col("rank")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
        ).withColumn("pid", F.col("pid").cast("bigint"))

    return query


def _dealt_sql(rank):
    return f"""SELECT l_orderkey % {P} AS pid, {rank} AS rank, count(*) AS n,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2"""


QUERIES = {
    "shuffle_round_robin": _dealt("round_robin"),
    "shuffle_contiguous": _dealt("contiguous"),
    "shuffle_custom_owner": _dealt(lambda pid, n, total: F.lit(n - 1) - F.pmod(pid, F.lit(n))),
}
ORACLES = {
    "shuffle_round_robin": _dealt_sql(f"(l_orderkey % {P}) % {RANKS}"),
    "shuffle_contiguous": _dealt_sql(f"((l_orderkey % {P}) * {RANKS}) // {P}"),
    "shuffle_custom_owner": _dealt_sql(f"{RANKS - 1} - (l_orderkey % {P}) % {RANKS}"),
}
