"""Building blocks of the operators: ordered groups, islands, range joins, seeded order."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A table is broadcast only when its counted rows are at most this.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted); unchanged otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, rows: int = SMALL) -> pa.Table | None:
    """The rows of ``df`` for use inside tasks, if it has at most ``rows`` of them; else None."""
    got = df.limit(rows + 1).toArrow()
    return got if got.num_rows <= rows else None


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is absent and the session is local; on a cluster, where
    executors would each write to their own disk, an absent setting is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/parlance-{label}-{uuid.uuid4().hex}"
    _scratched.append(path)
    return path


#: Paths that :func:`scratch` has given out and :func:`release` has not deleted yet.
_scratched: list[str] = []


def store(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return a scan of it: lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, mark: int = 0) -> int:
    """Delete what has been stored since ``mark``, once results that read it are written; returns the mark of now.

    With a mark of 0 all of the session's stored tables go.
    """
    hadoop = spark._jsc.hadoopConfiguration()
    for path in _scratched[mark:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    del _scratched[mark:]
    return len(_scratched)


def ordered_list(order: list[str], value: Column | str) -> Column:
    """Aggregate: values of a group in the order of some columns, whatever order the rows arrive in."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def with_islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of each group: ``starts`` is true on the first row of a run (null counts as true)."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(starts, F.lit(True)).cast("int")
    return df.withColumn("_s", flag).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def lag(col: str, by: list[str], order: list[str], n: int = 1) -> Column:
    return F.lag(col, n).over(Window.partitionBy(*by).orderBy(*order))


def lead(col: str, by: list[str], order: list[str], n: int = 1) -> Column:
    return F.lead(col, n).over(Window.partitionBy(*by).orderBy(*order))


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside closed ranges, by equal buckets of ``width``: a range goes to each bucket that it touches.

    The join is an equi-join on the keys and the bucket, so it is shuffled evenly and skew rules apply; pick
    ``width`` near the usual length of a range. Longer ranges use wider buckets, each length class (by powers of
    eight) its own, so that a range of any length goes to at most nine; a point goes to one bucket of each class
    that occurs. The exact bounds are left to the caller's filter.
    """
    kind = F.greatest(F.lit(0), F.ceil(F.log(8.0, F.greatest((F.col(end) - F.col(start)) / F.lit(8.0 * width), F.lit(1.0))))).cast("int")
    r = ranges.filter(F.col(end) >= F.col(start)).withColumn("_class", kind)
    size = F.lit(float(width)) * F.pow(F.lit(8.0), F.col("_class"))
    r = r.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    classes = sorted(x[0] for x in r.select("_class").distinct().collect())  # at most some twenty: one for each power of eight
    p = points.withColumn("_class", F.explode(F.array(*[F.lit(k) for k in classes]).cast("array<int>"))).withColumn("_bucket", F.floor(F.col(point) / size))
    return p.join(r, [*on, "_class", "_bucket"]).drop("_class", "_bucket")


def seeded(col: Column | str, seed: int = 777) -> Column:
    """A reproducible pseudo-random text to order by: the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(col) if isinstance(col, str) else col).cast("string")))


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row in a global order, in two passes as in :func:`numbered`."""
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sort = store(sort, "running")
    before = sort.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = before.withColumn("_ahead", F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).drop("_sum")  # one row a part
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sort.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_ahead")).drop("_part", "_at", "_own", "_ahead")


def numbered(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """Row numbers from 1 in a global order, in two passes: range-partitioned sort, then counts of the earlier parts.

    Unlike ``row_number`` over an unpartitioned window, no task sees more than its own range. The ranges come from a
    sample, so the sorted rows are written once and both passes read what was written.
    """
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sort = store(sort, "numbered")
    before = sort.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = before.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size"))
    return sort.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_size", "_first", "_before")
