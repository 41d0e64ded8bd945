"""Collectives over a logical rank column: all-gather, all-reduce and sparse all-to-all."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.running import numbered

Reducer = Callable[[Column, Column], Column]

REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}


def all_gather(df: DataFrame, rank: str = "rank", seq: str = "seq", ordered: bool = True) -> DataFrame:
    """Everything that any rank inserted, once, with a dense ``sequence`` from 0.

    Ordered: by rank, then by insertion (a whole number). The numbering counts rows per rank first (a partial aggregate)
    and numbers each rank by blocks, so no task holds a rank. Unordered: numbered as rows happen to lie, without a shuffle.
    """
    if not ordered:
        return df.withColumn("sequence", F.monotonically_increasing_id())
    sizes = df.groupBy(rank).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row per rank: bounded by the number of ranks.
    offsets = sizes.select(F.col(rank).alias("_rank"), before.alias("_before"))
    out = numbered(df, [rank], seq, "_nth").join(F.broadcast(offsets), F.col(rank) == F.col("_rank"))
    return out.withColumn("sequence", F.col("_before") + F.col("_nth")).drop("_nth", "_before", "_rank")


def replicate(df: DataFrame, nranks: int, rank: str = "dst") -> DataFrame:
    """One copy of every row for each rank, as gathered data is on all of them."""
    return df.withColumn(rank, F.explode(F.sequence(F.lit(0), F.lit(nranks - 1))))


def all_reduce(df: DataFrame, elem: str | list[str], **reductions: tuple[str, str]) -> DataFrame:
    """Element-wise built-in reduction over ranks: ``name=(column, "sum" | "min" | "max" | "product")``."""
    keys = [elem] if isinstance(elem, str) else elem
    for name, (_, op) in reductions.items():
        if op not in REDUCERS:
            raise ValueError(f"{name}: unknown reducer {op!r}; known: {sorted(REDUCERS)}")
    return df.groupBy(*keys).agg(*(REDUCERS[op](c).alias(name) for name, (c, op) in reductions.items()))


def tree_fold(values: list[Column], op: Reducer) -> Column:
    """Folds one value per rank in the fixed shape of a recursive-doubling exchange.

    With p the largest power of two up to n and r = n - p, the first 2r ranks pair up (even on the left); the p values
    that result are combined in a balanced tree in order, so operators need neither associate nor commute.
    """
    n = len(values)
    if not n:
        raise ValueError("nothing to reduce")
    p = 1 << (n.bit_length() - 1)
    r = n - p
    slots = [op(values[2 * i], values[2 * i + 1]) for i in range(r)] + values[2 * r :]
    while len(slots) > 1:
        slots = [op(slots[i], slots[i + 1]) for i in range(0, len(slots), 2)]
    return slots[0]


def all_reduce_tree(df: DataFrame, elem: str, rank: str, value: str, nranks: int, op: Reducer, result: str = "reduced") -> DataFrame:
    """Reduction with any binary operator over exactly one value per rank and element, in the shape of :func:`tree_fold`.

    One partial-and-final aggregate lays the ranks' values side by side. An element that some rank lacks reduces to null,
    as buffers of unequal size do not reduce.
    """
    if nranks <= 0:
        raise ValueError("nranks must be positive")
    wide = df.groupBy(elem).agg(*(F.max(F.when(F.col(rank) == k, F.col(value))).alias(f"_r{k}") for k in range(nranks)))
    whole = F.lit(True)
    for k in range(nranks):
        whole = whole & F.col(f"_r{k}").isNotNull()
    return wide.select(elem, F.when(whole, tree_fold([F.col(f"_r{k}") for k in range(nranks)], op)).alias(result))


def check_edges(edges: Iterable[tuple[int, int]], nranks: int) -> list[tuple[int, int]]:
    """Declared (source, destination) pairs: in range, never to oneself, none twice."""
    out = list(edges)
    for s, d in out:
        if not (0 <= s < nranks and 0 <= d < nranks):
            raise IndexError(f"edge {(s, d)} leaves [0, {nranks})")
        if s == d:
            raise IndexError(f"rank {s} can't exchange with itself")
    if len(set(out)) != len(out):
        raise ValueError("an edge is declared twice")
    return out


def sparse_all_to_all(df: DataFrame, edges: Iterable[tuple[int, int]], nranks: int, src: str = "src", dst: str = "dst", seq: str = "seq", strict: bool = False) -> DataFrame:
    """Messages along declared edges, with their ``ordinal`` in each sender's order (``seq``, a whole number).

    Ordinals are counted by blocks, so that an edge with very many messages is spread over tasks.
    Messages off the edges are left out, or where ``strict`` raise while the query runs. Edges are a small validated
    list, so they become a literal filter rather than a join.
    """
    declared = check_edges(edges, nranks)
    allowed = F.lit(False)
    for s in sorted({s for s, _ in declared}):
        allowed = allowed | ((F.col(src) == s) & F.col(dst).isin([d for a, d in declared if a == s]))
    if strict:
        kept = df.where(F.when(allowed, F.lit(True)).otherwise(F.raise_error(F.lit("message off the declared edges")).cast("boolean")))
    else:
        kept = df.where(allowed)
    return numbered(kept, [src, dst], seq, "ordinal")
