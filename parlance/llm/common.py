"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A table is broadcast only after its rows have been counted and are no more than this.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is absent and the session is local; on a cluster, where
    executors would each write to their own disk, an absent setting is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/parlance-{label}-{uuid.uuid4().hex[:12]}"


#: Tables that :func:`store` has written and nothing has deleted yet.
_stored: list[str] = []


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return a scan of it: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parlance_path = path
    _stored.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`store` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_parlance_path", None)
        if path:
            _delete(df.sparkSession, path)
            _stored.remove(path)


def stored_now() -> int:
    """A mark for :func:`release`."""
    return len(_stored)


def release(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables stored since ``mark`` but for ``keep``; call it when results that read them are written."""
    kept = {getattr(df, "_parlance_path", None) for df in keep}
    for path in [p for p in _stored[mark:] if p not in kept]:
        _delete(spark, path)
        _stored.remove(path)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free heap pages to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return memory that is no longer used to the system: workers live on, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a slice take about ``size`` bytes at most."""
    import pyarrow.compute as pc

    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(length, dtype=np.int64), 0
        while first < b.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield b.slice(first, last - first)
            first = last
        del b
        give_back()


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: numpy's own way for whole numbers hashes them, which takes longer."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, keep: int) -> DataFrame:
    """One narrow pass of Python over texts, through Arrow.

    ``df`` holds ``keep`` columns that pass unchanged, as Arrow arrays, so that integer ids beside nulls stay
    exact, and then the text. ``make`` is called once a task and gives the function from a slice's texts to its
    new columns. ``schema`` names the kept columns and the new ones.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")][keep:]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in sliced(batches, keep):
            cols = [pa.array(v, types[k]) for v, k in zip(work(b.column(keep).to_pylist()), kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *cols], names)

    return df.mapInArrow(run, schema)


def join_checked(df: DataFrame, side: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored table, broadcast only when its counted rows are at most ``rows``; else a shuffled join."""
    return df.join(F.broadcast(side) if side.count() <= rows else side.hint("merge"), on, how)


def fresh(columns: list[str], base: str) -> str:
    """A column name that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def ascii_lower(col):
    """Lower-case A-Z only, so that every engine agrees."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For bytes.translate: lower-case A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes; null has none."""
    if not text:
        return []
    b = text.encode("utf-8", "surrogatepass")
    return (b.translate(LOWER) if lower else b).split()


def ids_crc32(ids) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col, divisor: int):
    """``crc32(id as text) mod divisor``: the fold rule of the scoring contracts."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(divisor)
