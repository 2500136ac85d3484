"""Streams with state of their own: job status machines, tokens that expire, and counts of late rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

c = F.col

#: The statuses of a job and those that may follow each. A job begins pending (P), downloads (D, C), is
#: queued (Q), runs (R), ends (N) or fails (F), uploads (U, W); errors (E) may be submitted again, cleaned jobs (Z) too;
#: a job that does not run may be marked for deletion (X).
FLOW = {
    "P": "DEX", "D": "CEX", "C": "QEX", "Q": "REX", "R": "NFE", "N": "UEX", "U": "WEX", "W": "X", "F": "XZ", "E": "PXZ", "Z": "PX", "X": "",
}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Jobs share their state by a hash of their id in this many lots, fixed for a stream's life: a call to the state, a frame and a
#: timer then serve a lot, however many jobs there are. A lot's waiting events are worked through in memory.
LOTS = 1 << 14
#: Waiting events of one entry of the state that is written anew.
ENTRY = 10_000


class StatusMachine(StatefulProcessor):
    """Applies a job's events in event time: they wait in the state until the watermark has passed them.

    So neither the order of arrival nor the cut into micro-batches changes what is accepted. Events that arrive
    behind the watermark are dropped by Spark before they get here. The events of a lot wait in one list, an entry for
    each frame of arrivals, with a timer at the earliest; the status of each job is an entry of a map.
    """

    def __init__(self, flow: dict[str, str], first: str):
        self.flow, self.first = flow, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getMapState("now", "jobid string", "status string")
        self.waiting = handle.getListState("waiting", "jobid array<string>, us array<long>, event_id array<string>, status array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for batch in rows:
            self.waiting.appendList([tuple(batch[x].tolist() for x in ("jobid", "us", "event_id", "status"))])
            earliest.append(int(batch["us"].min()))
        self.handle.registerTimer(min(earliest) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, later = {}, []
        for entry in self.waiting.get():
            for jobid, us, event_id, status in zip(*entry):
                if us // 1000 < mark:
                    due.setdefault(jobid, []).append((us, event_id is None, int(event_id or 0), status or "", status))
                else:
                    later.append((jobid, us, event_id, status))
        if not due:
            return
        self.waiting.clear()
        if later:
            self.waiting.put([tuple(map(list, zip(*later[i : i + ENTRY]))) for i in range(0, len(later), ENTRY)])
            self.handle.registerTimer(min(us for _, us, _, _ in later) // 1000 + 1)
        out = []
        for jobid, events in due.items():
            known = self.now.getValue((jobid,))
            before = now = known[0] if known else None
            for _, nameless, event_id, _, status in sorted(events, key=lambda e: e[:4]):
                legal = status == self.first if now is None else status is not None and status in self.flow.get(now, "")
                out.append((jobid, None if nameless else event_id, now, status, legal))
                now = status if legal else now
            if now != before:
                self.now.updateValue((jobid,), (now,))
        yield pd.DataFrame(out, columns=["jobid", "event_id", "before", "status", "legal"], dtype=object)

    def close(self) -> None:
        pass


def status_log(events: DataFrame, flow: dict[str, str] | None = None, first: str = "P") -> DataFrame:
    """Every event of a job (jobid, event_id, status; event time ``at`` with a watermark) with the status before it.

    ``legal`` says whether the job could take it: the first status of a job must be ``first``, each later one among those
    that may follow. An illegal event changes nothing, so a finished job stays finished and one in error leaves it
    only by a new submission, a cleanup or a deletion. Events are judged in the order of event time and id once
    the watermark has passed them. A null status is illegal, and an event without a time, which is never passed, is left out.
    """
    # ids travel as texts: in a frame, numbers with nulls among them become floats
    cols = ["jobid", F.unix_micros("at").alias("us"), c("event_id").cast("string").alias("event_id"), "status", "at"]
    rows = events.filter("at is not null").select(F.pmod(F.xxhash64("jobid"), F.lit(LOTS)).cast("int").alias("lot"), *cols)
    schema = "jobid string, event_id long, before string, status string, legal boolean"
    return rows.groupBy("lot").transformWithStateInPandas(StatusMachine(flow or FLOW, first), schema, outputMode="append", timeMode="EventTime")


class TokenStore(StatefulProcessor):
    """Tokens of a user by their expiry; a timer at the earliest emits all that have died, frees their state and waits for the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "token long, expiry long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            tokens, ends = batch["token"].tolist(), batch["expiry_us"].tolist()
            self.live.appendList(list(zip(tokens, ends)))
            self.handle.registerTimer(min(ends) // 1000 + 1)
            yield pd.DataFrame({"user": [key[0]] * len(tokens), "token": tokens, "action": "issued"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        live = {token: us for token, us in self.live.get()}  # a token issued again has its last expiry
        dead = sorted(token for token, us in live.items() if us // 1000 < mark)
        if not dead:
            return
        self.live.clear()
        left = [(token, us) for token, us in live.items() if us // 1000 >= mark]
        if left:
            self.live.put(left)
            self.handle.registerTimer(min(us for _, us in left) // 1000 + 1)
        yield pd.DataFrame({"user": [key[0]] * len(dead), "token": dead, "action": "expired"})

    def close(self) -> None:
        pass


def token_log(logins: DataFrame) -> DataFrame:
    """Tokens (user, token, expiry; event time ``at`` with a watermark) as they are issued and as they expire.

    A token lives while the event time has not passed its expiry. Each is in the state from its issue to its
    expiry, so the state holds living tokens only, however long the stream runs.
    """
    rows = logins.select("user", "token", "at", F.unix_micros("expiry").alias("expiry_us"))
    return rows.groupBy("user").transformWithStateInPandas(TokenStore(), "user long, token long, action string", outputMode="append", timeMode="EventTime")


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which lists, maps and timers need, and rows behind the watermark of the batch before dropped at
    once; with several stateful operators in a chain allowed, Spark would let them through for one batch more."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.statefulOperator.allowMultiple": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_stateful(stream: DataFrame) -> DataFrame:
    """All that a stream with state of its own appends over what is there now."""
    from .streams import run_available

    with settings(stream.sparkSession):
        return run_available(stream, "append")


def late_rows(spark: SparkSession, folder: str, schema, watermark: str, id_col: str = "event_id") -> DataFrame:
    """Rows of each micro-batch, one file a batch in the order of their times, and how many lay behind the watermark.

    Rows are kept once by id within the watermark, an operator that sees each row: what it drops as late is what
    Spark reports of it, batch by batch. Columns batch, n_rows, n_late.
    """
    from ..operators.helpers import scratch

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = stream.withWatermark("at", watermark).dropDuplicatesWithinWatermark([id_col])
    with settings(spark):
        query = kept.writeStream.format("noop").outputMode("append").option("checkpointLocation", scratch(spark, "late")).trigger(availableNow=True).start()
        query.awaitTermination()
    told = [(p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)) for p in query.recentProgress if p.numInputRows]
    return spark.createDataFrame(told, "batch long, n_rows long, n_late long")
