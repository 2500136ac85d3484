"""Best rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order: the row-number limit also prunes before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
