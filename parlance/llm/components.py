"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns node, component.

    Each round does a large-star step (every node hands its smallest neighbour to its larger neighbours) and a
    small-star step (to its smaller ones), which keeps the components and shrinks the paths, so the rounds grow
    with the logarithm of the longest path. Both steps are an aggregate by node, joined back to the edges: the
    neighbours of a hub are never gathered into one row, and a hub's edges are split by the skew-join rule. The
    edges are written to the shared folder after each round, so a lost executor costs one round at most.

    Self-loops and repeated edges are harmless. Nulls on either side are dropped. No edges give no rows.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    state = store(e, "edges")
    sign = _signature(state)
    for _ in range(max_rounds):
        # large star: for u and its neighbours v > u: (v, min of u and all its neighbours)
        both = state.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(state.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()
        # small star: for u and its neighbours v < u: (v, min), and (u, min)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low.hint("merge"), "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo < hi").unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct()
        nxt = store(small, "edges")
        new = _signature(nxt)
        discard(state)
        state = nxt
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("connected components did not settle")
    roots = state.select(F.col("lo").alias("node")).distinct()
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _signature(edges: DataFrame) -> tuple:
    """Row count and order-free hash sum: equal when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
