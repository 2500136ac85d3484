"""Keeping one row of each class of near-duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import fresh, join_checked, store


def one_row_each(docs: DataFrame, classes: DataFrame, mark: Callable[[DataFrame, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs``, all columns unchanged: of each class, the row of its smallest id.

    ``classes`` is a stored table of key, root and component_id (null where no row of the class has an id), and
    ``mark`` adds the key of each row as a column of a given name. Rows of one id are one document: of those, the
    row of the smallest text stays (the smallest as JSON, if texts are the same). Rows without an id stay only
    where their class has no id, and then one of each class, chosen in the same way.

    The ids that go are fewer than those that stay, so full rows meet the former; rows are shuffled only if these
    are too many to broadcast.
    """
    id_ = F.col(f"`{id_col}`").cast("long")
    keep = classes.filter("component_id is not null").select("component_id").distinct()
    named = docs.filter(id_.isNotNull())
    ids = store(named.groupBy(id_.alias("id")).agg(F.count("*").alias("n")), "ids")
    gone = fresh(docs.columns, "_gone")
    drop = store(ids.join(keep.hint("merge"), F.col("id") == F.col("component_id"), "left_anti").select(F.col("id").alias(gone)), "gone")
    out = join_checked(named, drop, id_ == F.col(gone), "left_anti")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), F.to_json("row"))
    first = F.min_by("row", order).alias("row")  # combines in the task first: copies may be many
    often = store(ids.filter("n > 1").select(F.col("id").alias(gone)), "often")
    if not often.isEmpty():
        again = join_checked(out, often, id_ == F.col(gone), "left_semi").select(id_.alias("id"), row.alias("row"))
        out = join_checked(out, often, id_ == F.col(gone), "left_anti").unionByName(again.groupBy("id").agg(first).select("row.*"))

    nameless = classes.filter("component_id is null").select("key", "root")
    if nameless.isEmpty():
        return out
    name = fresh(docs.columns, "_key")
    marked = mark(docs.filter(id_.isNull()), name).select(F.col(name).alias("key"), row.alias("row"))
    return out.unionByName(marked.join(nameless.hint("merge"), "key").groupBy("root").agg(first).select("row.*"))
