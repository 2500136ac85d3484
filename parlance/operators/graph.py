"""Connected components by repeated smallest-label exchange, with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .helpers import store


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest node reachable from each node of the edges (a, b): node, component. Strings order by bytes.

    Each round every node takes the smallest label among itself, its neighbours and its label's label, so long
    paths shrink by doubling. Labels are written to the folder of ``spark.checkpoint.dir`` each round.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        far = labels.select(F.col("node").alias("_n"), F.col("component").alias("far"))
        new = labels.join(near, F.col("node") == F.col("a")).join(far, F.col("component") == F.col("_n"), "left")
        new = store(new.select("node", F.least("component", "m", "far").alias("component"), F.col("component").alias("old")))
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
