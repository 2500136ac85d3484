"""Registered queries: streams over the events table, each equal to its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful as st, streams as t
from .adapters import query, table

c = F.col


def _stream(s, sf):
    return t.read_events(s, sf, table(s, sf, "events").schema)


@query("t1_latest_job_status", "SELECT username, arg_max(status, [epoch_us(creation), event_id]) AS status, arg_max(event_id, [epoch_us(creation), event_id]) AS event_id, count(*) AS n FROM v_jobs GROUP BY username")
def t1(s, sf):
    k = F.create_map(*[F.lit(x) for x in ("signup", "P", "view", "Q", "click", "R", "purchase", "N", "error", "E")])
    e = _stream(s, sf).select(c("user_id").cast("string").alias("username"), k[c("event_type")].alias("status"), "at", "event_id")
    return t.run_available(t.latest_status(e))


@query("t2_active_tokens", "SELECT event_id, user_id FROM events WHERE ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-15'")
def t2(s, sf):
    e = _stream(s, sf).withColumn("expiry", c("at") + F.expr("interval 1 day"))
    return t.run_available(t.active_tokens(e, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "user_id"), "append")


@query("t3_speech_sessions", "WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), i AS (SELECT *, sum(CASE WHEN ts - b < INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM p) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS \"end\", count(*) AS n FROM i GROUP BY user_id, k")
def t3(s, sf):
    out = t.run_available(t.sessions(_stream(s, sf), "2 hours"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("t4_tumbling_chunks", "SELECT epoch_us(ts) // 600000000 * 600000000 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def t4(s, sf):
    return t.run_available(t.chunks(_stream(s, sf), "600 seconds")).withColumn("start", F.unix_micros("start"))


@query("t5_sliding_chunks", "WITH w AS (SELECT unnest([epoch_us(ts) // 25000000, epoch_us(ts) // 25000000 - 1]) * 25000000 AS start, epoch_us(ts) AS t, value FROM events) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE t < start + 30000000 GROUP BY start")
def t5(s, sf):
    return t.run_available(t.chunks(_stream(s, sf), "30 seconds", "25 seconds")).withColumn("start", F.unix_micros("start"))


@query("t6_running_mean", "SELECT event_id, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def t6(s, sf):
    return t.running_mean(_stream(s, sf)).select("event_id", "user_id", "n", F.round("total", 2).alias("total"))


@query("t7_dedup_hits_stream", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT *, t AS last, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.*, CASE WHEN o.t - r.last >= 3600 THEN o.t ELSE r.last END, o.t - r.last >= 3600 FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1) SELECT event_id, user_id, t FROM r WHERE kept""")
def t7(s, sf):
    return t.dedup_hits(_stream(s, sf), 3600.0)


@query("t8_windows_after_watermark", "WITH w AS (SELECT epoch_us(ts) // 600000000 * 600000000 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1) SELECT * FROM w WHERE start + 600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000")
def t8(s, sf):
    return t.run_available(t.chunks(_stream(s, sf), "600 seconds"), "append").withColumn("start", F.unix_micros("start"))


#: Statuses of events: their type and the remainder of their id by three.
STATUSES = {"signup": "PRZ", "view": "DND", "click": "CUC", "purchase": "QWQ", "error": "EXF"}
_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUSES.items())
_NEXT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in st.FLOW.items())


@query("t1_status_machine", f"""WITH RECURSIVE e AS (SELECT user_id || '-' || (epoch_us(ts) // 864000000000) AS jobid, event_id, ts, substr(CASE event_type {_STATUS} END, 1 + (event_id % 3)::INTEGER, 1) AS status FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY jobid ORDER BY ts, event_id) AS rn FROM e WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 600000),
 r AS (SELECT jobid, event_id, NULL::VARCHAR AS before, status, status = 'P' AS legal, rn, CASE WHEN status = 'P' THEN 'P' END AS now FROM o WHERE rn = 1
 UNION ALL SELECT o.jobid, o.event_id, r.now, o.status, CASE WHEN r.now IS NULL THEN o.status = 'P' ELSE contains(CASE r.now {_NEXT} END, o.status) END, o.rn,
 CASE WHEN CASE WHEN r.now IS NULL THEN o.status = 'P' ELSE contains(CASE r.now {_NEXT} END, o.status) END THEN o.status ELSE r.now END FROM r JOIN o ON o.jobid = r.jobid AND o.rn = r.rn + 1)
 SELECT jobid, event_id, before, status, legal FROM r""")
def t1_machine(s, sf):
    kind = F.create_map(*[F.lit(x) for p in STATUSES.items() for x in p])[c("event_type")]
    job = F.concat_ws("-", c("user_id").cast("string"), F.floor(F.unix_micros("at") / 864_000_000_000).cast("string"))
    e = _stream(s, sf).select(job.alias("jobid"), "event_id", F.substr(kind, (c("event_id") % 3 + 1).cast("int"), F.lit(1)).alias("status"), "at")
    return st.run_stateful(st.status_log(e))


@query("t2_token_log", """SELECT user_id AS user, event_id AS token, 'issued' AS action FROM events WHERE event_type = 'signup'
 UNION ALL SELECT user_id, event_id, 'expired' FROM events WHERE event_type = 'signup' AND epoch_ms(ts) + 86400000 < (SELECT max(epoch_ms(ts)) FROM events WHERE event_type = 'signup') - 600000""")
def t2_log(s, sf):
    e = _stream(s, sf).filter("event_type = 'signup'")
    return st.run_stateful(st.token_log(e.select(c("user_id").alias("user"), c("event_id").alias("token"), "at", (c("at") + F.expr("interval 1 day")).alias("expiry"))))


@query("t8_late_rows", """WITH e AS (SELECT ts, (CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END) + (CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS file FROM events),
 f AS (SELECT CASE file WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS batch, ts FROM e), m AS (SELECT f1.batch, (SELECT max(epoch_ms(ts)) - 600000 FROM f f2 WHERE f2.batch < f1.batch) AS mark FROM (SELECT DISTINCT batch FROM f) f1)
 SELECT batch, count(*) AS n_rows, count(*) FILTER (epoch_ms(ts) <= mark) AS n_late FROM f JOIN m USING (batch) GROUP BY batch""")
def t8_late(s, sf):
    """Every tenth event arrives after its half of the month is over, in a file of its own: most of those are late."""
    from ..operators.helpers import scratch

    e = table(s, sf, "events").withColumn("at", c("ts").cast("timestamp"))
    path = scratch(s, "arrivals")
    late, second = c("event_id") % 10 == 0, c("ts") >= F.lit("2024-01-16").cast("timestamp")
    for part in (~late & ~second, late & ~second, ~late & second, late & second):
        e.filter(part).coalesce(1).write.mode("append").parquet(path)  # one file each, in this order
    return st.late_rows(s, path, e.schema, "10 minutes")
