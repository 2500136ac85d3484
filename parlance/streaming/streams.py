"""Structured Streaming forms of batch rules: job states, tokens, sessions, chunks, running means, hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

c = F.col


def read_events(spark: SparkSession, folder: str, schema, watermark: str = "10 minutes", files: int = 64) -> DataFrame:
    """Events as a stream over a folder of Parquet, with event time ``at`` and its watermark; a micro-batch takes at most ``files`` files."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(folder)
    return s.withColumn("at", c("ts").cast("timestamp")).withWatermark("at", watermark)


def latest_status(events: DataFrame) -> DataFrame:
    """Last status of each job (username) by event time, whatever it is; :func:`stateful.status_log` judges the transitions."""
    last = F.max_by(F.struct("status", "event_id"), F.struct("at", "event_id"))
    return events.groupBy("username").agg(last.alias("l"), F.count("*").alias("n")).select("username", c("l.status").alias("status"), c("l.event_id").alias("event_id"), "n")


def active_tokens(tokens: DataFrame, now) -> DataFrame:
    """Tokens whose expiry has not passed."""
    return tokens.filter(c("expiry") >= now)


def sessions(events: DataFrame, gap: str, by: str = "user_id") -> DataFrame:
    """Spans of activity that end after ``gap`` without an event."""
    w = F.session_window("at", gap)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(by, c("w.start").alias("start"), c("w.end").alias("end"), "n")


def chunks(events: DataFrame, length: str, step: str | None = None) -> DataFrame:
    """Counts and sums in tumbling windows, or sliding ones with ``step``."""
    w = F.window("at", length, step) if step else F.window("at", length)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(c("w.start").alias("start"), "n", "total")


def run_in_order(stream: DataFrame, by: str, order: list[str], walk: Callable, schema: str, state: str) -> DataFrame:
    """Run a rule over each key's rows in order, with state from micro-batch to micro-batch, over all that is there now.

    ``walk`` is a generator of (key, state or None, rows): it yields output tuples and returns the key's new state.
    Each micro-batch is joined by the states so far, sorted by Spark and streamed (:func:`operators.streamed.in_order`), so
    neither a key's rows nor a batch are in memory at once. Output and states of a batch are one table under the
    batch's number: a repeated batch writes both anew.
    """
    from ..operators.helpers import scratch
    from ..operators.streamed import in_order

    spark, path = stream.sparkSession, scratch(stream.sparkSession, "ordered")
    kind = stream.schema[by].dataType.simpleString()
    row = stream.schema.simpleString()
    step = f"out struct<{schema}>, key {kind}, kept struct<{state}>"

    def turn(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = iter(rows)
        first = next(rows)
        known = first[2] if first[1] == 0 else None
        rest = rows if first[1] == 0 else chain([first], rows)
        work = walk(key[0], known, (r[3] for r in rest))
        while True:
            try:
                yield (next(work), None, None)
            except StopIteration as end:
                yield (None, key[0], end.value)
                return

    def sink(batch: DataFrame, number: int) -> None:
        new = batch.select(c(by).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(f"struct<{state}>").alias("kept"), F.struct(*batch.columns).alias("row"))
        if number:
            before = spark.read.schema(step).parquet(f"{path}/batch={number - 1}").filter("kept is not null")
            new = new.unionByName(before.select("key", F.lit(0).alias("kind"), "kept", F.lit(None).cast(row).alias("row")))
        ordered = in_order(new, ["key"], ["kind", *[c(f"row.{x}") for x in order]], turn, step)
        ordered.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(step).parquet(path).filter("out is not null").select("out.*")


def running_mean(events: DataFrame) -> DataFrame:
    """Each value less the mean of its user's values so far, in order of time and event id within a micro-batch; state is (n, sum)."""

    def walk(user: int, known: dict | None, rows: Iterator[dict]):
        n, total = (known["n"], known["total"]) if known else (0, 0.0)
        for r in rows:
            n, total = n + 1, total + r["value"]
            yield (r["event_id"], user, n, total, r["value"] - total / n)
        return (n, total)

    cols = events.select("user_id", "event_id", "at", "value")
    return run_in_order(cols, "user_id", ["at", "event_id"], walk, "event_id: bigint, user_id: bigint, n: bigint, total: double, centred: double", "n: bigint, total: double")


def running_mean_batch(events: DataFrame) -> DataFrame:
    """Batch twin of :func:`running_mean`."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", "user_id", F.count("*").over(w).alias("n"), F.sum("value").over(w).alias("total"), (c("value") - F.avg("value").over(w)).alias("centred"))


def dedup_hits(hits: DataFrame, gap: float = 0.5) -> DataFrame:
    """First hit of each cluster (user_id, event time in seconds): one within ``gap`` of the last kept hit is dropped."""

    def walk(user: int, known: dict | None, rows: Iterator[dict]):
        last = known["last"] if known else float("-inf")
        for r in rows:
            if r["t"] - last >= gap:
                last = r["t"]
                yield (r["event_id"], user, last)
        return (last,)

    h = hits.select("user_id", "event_id", (F.unix_micros("at") / 1e6).alias("t"))
    return run_in_order(h, "user_id", ["t", "event_id"], walk, "event_id: bigint, user_id: bigint, t: double", "last: double")


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote: the last state for ``complete``, all rows for ``append``.

    The sink is a table in the folder of ``spark.checkpoint.dir``, written batch by batch under the batch's number,
    so a repeated batch replaces itself.
    """
    from ..operators.helpers import scratch

    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").drop("batch")
