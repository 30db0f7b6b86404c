"""Connected components of a graph that is too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.storage import store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node that it is connected to.

    Alternates two star operations (each node links its larger neighbours, then its smaller ones, to the smallest
    of its neighbourhood), so that rounds grow as the logarithm of the diameter. Minima are computed by partial
    aggregation; each round's edges and minima are written to the shared folder, so both sides of the joins are
    plain exchanges which adaptive execution can split at a hub. Self links and nulls are dropped: a node
    without any other neighbour is its own component, which callers restore by a left join.
    """
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    first = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = store(first.select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    mark = _mark(now.df)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(least.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "edges")
        least2 = store(large.df.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.df.join(least2.df, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = store(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        was, mark = mark, _mark(small.df)
        for old in (now, least, large, least2):
            old.remove()
        now = small
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
