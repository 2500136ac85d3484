"""Groups worked through in order, row by row: partitions are sorted by Spark and streamed, so a group need not fit in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch on the way out.
BATCH = 8192


def in_order(df: DataFrame, by: list[str], order: list, walk: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``walk`` makes of each group of ``by``: it gets the group's key and its rows, lazily and in the given order.

    Rows are tuples of all columns of ``df``. Groups are dealt by a hash of the key and each partition is sorted by
    key and order, so a group is one run of rows in one task, and only what ``walk`` itself keeps of it is in memory.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    at = [df.columns.index(k) for k in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(x.to_pylist() for x in b.columns)))
        made = (out for key, group in groupby(rows, key=lambda r: tuple(r[i] for i in at)) for out in walk(key, group))
        while some := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some), arrow)], schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
