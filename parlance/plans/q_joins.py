"""Registered queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from . import adapters as v
from .adapters import query

c = F.col


@query("c1_ctm_to_recording", "SELECT utt, file, r.channel, round(s.start + w.start, 2) AS start, dur, word, conf, round(s.start + w.start, 2) + dur > s.\"end\" + 0.01 AS past_end FROM v_ctm w JOIN v_segments s USING (utt) JOIN v_reco2file r USING (rec)")
def c1(s, sf):
    return j.ctm_to_recording(v.ctm(s, sf), v.segments(s, sf), v.reco2file(s, sf))


def _abs_words(s, sf):
    return j.segment_words(v.segments(s, sf), v.ctm(s, sf))


def _grid(s, sf):
    seg = v.segments(s, sf)
    return seg.select("rec", F.concat("utt", F.lit("-a")).alias("seg"), "start", (c("start") + 7.5).alias("end")).unionByName(seg.select("rec", F.concat("utt", F.lit("-b")).alias("seg"), (c("start") + 6.0).alias("start"), "end"))


@query("c2_words_in_segments", """WITH w AS (SELECT rec, round(round(s.start, 2) + t.start, 2) AS ws, round(round(round(s.start, 2) + t.start, 2) + dur, 2) AS we, word FROM v_ctm t JOIN v_segments s USING (utt)),
 g AS (SELECT rec, utt || '-a' AS seg, start AS a, start + 7.5 AS b FROM v_segments UNION ALL SELECT rec, utt || '-b', start + 6.0, "end" FROM v_segments)
 SELECT rec, seg, string_agg(word, ' ' ORDER BY ws, we, word) AS text, count(*) AS n_words FROM w JOIN g USING (rec) WHERE ws >= a AND we <= b GROUP BY rec, seg""")
def c2(s, sf):
    return j.words_in_segments(_abs_words(s, sf).select("rec", "start", "dur", "word"), _grid(s, sf))


def _words_and_phones(s, sf):
    t = v.ctm(s, sf)
    at = F.round(c("start") * 100).cast("long")
    w = t.select(c("utt").alias("rec"), at.alias("start"), (at + F.round(c("dur") * 100).cast("long")).alias("end"), "word")
    p = t.filter("pos % 2 = 0").select(c("utt").alias("rec"), (at + 15).alias("mid"), F.substring("word", 1, 1).alias("phone")).unionByName(t.select(c("utt").alias("rec"), at.alias("mid"), F.lit("x").alias("phone")))
    return w, p


@query("c3_phones_in_words", """WITH w AS (SELECT utt AS rec, round(start * 100)::BIGINT AS a, round(start * 100)::BIGINT + round(dur * 100)::BIGINT AS b, word FROM v_ctm),
 p AS (SELECT utt AS rec, round(start * 100)::BIGINT + 15 AS mid, substr(word, 1, 1) AS phone FROM v_ctm WHERE pos % 2 = 0 UNION ALL SELECT utt, round(start * 100)::BIGINT, 'x' FROM v_ctm)
 SELECT rec, mid, phone, word FROM p JOIN w USING (rec) WHERE mid > a AND mid < b""")
def c3(s, sf):
    return j.phones_in_words(*_words_and_phones(s, sf)).select("rec", "mid", "phone", "word")


@query("c3_merge_join", same_as="c3_phones_in_words")
def c3_swept(s, sf):
    return j.phones_in_words_swept(*_words_and_phones(s, sf)).select("rec", "mid", "phone", "word")


@query("c4_nearest_silence", """WITH t AS (SELECT rec, max(end_cs) / 5.0 AS step FROM v_labelseg GROUP BY rec), g AS (SELECT rec, k AS id, step * k AS pt FROM t, range(1, 5) x(k)),
 p AS (SELECT DISTINCT rec, start_cs::DOUBLE AS a FROM v_labelseg UNION SELECT rec, 0.0 FROM t)
 SELECT rec, id, round(min(pt), 6) AS target, arg_min(a, [abs(a - pt), a]) AS nearest FROM g JOIN p USING (rec) GROUP BY rec, id""")
def c4(s, sf):
    e = v.labelseg(s, sf)
    step = e.groupBy("rec").agg((F.max("end_cs") / 5.0).alias("step"))
    targets = step.select("rec", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("id"), "step").select("rec", c("id").cast("long").alias("id"), (c("step") * c("id")).alias("at"))
    return j.nearest_points(targets, e.select("rec", c("start_cs").cast("double").alias("at")), "rec").select("rec", "id", F.round("at", 6).alias("target"), "nearest")


@query("c5_segment_words", "SELECT utt, rec, round(round(s.start, 2) + w.start, 2) AS start, dur, word, conf FROM v_ctm w JOIN v_segments s USING (utt)")
def c5(s, sf):
    return _abs_words(s, sf)


@query("c6_fill_missing", "SELECT utt, channel, start, dur, word FROM v_ctm WHERE length(utt) % 2 = 0 UNION ALL SELECT utt, '1', 0.0::DOUBLE, 0.0::DOUBLE, 'EMPTY_RECOGNIZED_PHRASE' FROM v_segments WHERE length(utt) % 2 = 1")
def c6(s, sf):
    return j.fill_missing(v.ctm(s, sf).filter("length(utt) % 2 = 0"), v.segments(s, sf))


@query("c7_reco_key_join", "SELECT DISTINCT file, kwid, h.channel, r.rec FROM (SELECT 'f' || file AS file, 'A' AS channel, kwid FROM v_hits) h JOIN v_reco2file r USING (file, channel)")
def c7(s, sf):
    h = v.hits(s, sf).select(F.concat(F.lit("f"), "file").alias("file"), F.lit("A").alias("channel"), "kwid").distinct()
    return j.by_file_channel(h, v.reco2file(s, sf))


@query("c8_speaker_for_segments", "SELECT utt || '-new' AS utt, 'spk' || rec AS spk FROM v_segments")
def c8(s, sf):
    seg = v.segments(s, sf)
    return j.speakers_of_segments(seg.select("utt", "rec"), seg.select("utt", F.concat(F.lit("spk"), "rec").alias("spk")), seg.select(F.concat("utt", F.lit("-new")).alias("utt"), "rec"))


@query("c9_attach_transcripts", "SELECT utt, spk, array_to_string(words, ' ') AS text FROM v_utt2spk LEFT JOIN v_text USING (utt)")
def c9(s, sf):
    return j.attach(v.utt2spk(s, sf), v.text(s, sf).select("utt", F.array_join("words", " ").alias("text")), "utt", "text")


@query("c10_attach_counts", "SELECT word, n FROM v_lexicon JOIN (SELECT word, count(*) AS n FROM v_words GROUP BY word) USING (word)")
def c10(s, sf):
    return j.attach(v.lexicon(s, sf).select("word"), v.words(s, sf).groupBy("word").agg(F.count("*").alias("n")), "word", "n", strict=True)


def _frames(s, sf):
    f = v.feats(s, sf)
    return f.select(F.concat(F.lit("u"), F.floor(c("vec_id") / 10)).alias("utt"), (c("vec_id") % 10).alias("frame"), "vec")


@query("c11_paste_features", """WITH f AS (SELECT 'u' || (vec_id // 10) AS utt, vec_id % 10 AS frame, vec FROM v_feats), b AS (SELECT * FROM f WHERE NOT (frame = 9 AND utt LIKE '%3') AND NOT (frame > 5 AND utt LIKE '%4')),
 n AS (SELECT utt FROM (SELECT utt, count(*) AS a FROM f GROUP BY utt) JOIN (SELECT utt, count(*) AS b FROM b GROUP BY utt) USING (utt) WHERE abs(a - b) <= 1)
 SELECT utt, frame, len(f.vec) + len(b.vec) AS dim, round(list_sum(f.vec) + list_sum(b.vec), 4) AS total FROM f JOIN b USING (utt, frame) WHERE utt IN (SELECT utt FROM n)""")
def c11(s, sf):
    f = _frames(s, sf)
    b = f.filter("not (frame = 9 and utt like '%3') and not (frame > 5 and utt like '%4')")
    return j.paste_features(f, b, 1).select("utt", "frame", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("c12_pair_by_id", "SELECT utt, l.n AS n_left, r.n AS n_right, CASE WHEN l.utt IS NULL THEN 'left' WHEN r.utt IS NULL THEN 'right' END AS missing FROM (SELECT utt, len(words) AS n FROM v_text WHERE utt::BIGINT % 7 <> 0) l FULL JOIN (SELECT utt, len(words) AS n FROM v_text WHERE utt::BIGINT % 5 <> 0) r USING (utt)")
def c12(s, sf):
    t = v.text(s, sf).select("utt", F.size("words").alias("n"))
    return j.pair_by_id(t.filter("cast(utt as long) % 7 <> 0").withColumnRenamed("n", "n_left"), t.filter("cast(utt as long) % 5 <> 0").withColumnRenamed("n", "n_right"), "utt")


def _services(s, sf):
    e = v.jobs(s, sf)
    services = e.select(F.concat(F.lit("svc"), "status").alias("name")).distinct().withColumn("command", F.concat(F.lit("run "), "name"))
    require = services.select("name", F.lit("Y").alias("audio"), F.when(c("name") == "svcQ", "Y").otherwise("N").alias("text"))
    subs = e.filter("username < '20'").select(F.concat(F.lit("svc"), "status").alias("service"), F.concat(F.lit("s"), "username").alias("subsystem")).distinct()
    return services, require, subs


SERVICES = """services AS (SELECT DISTINCT 'svc' || status AS name, 'run svc' || status AS command FROM v_jobs), require AS (SELECT name, 'Y' AS audio, CASE WHEN name = 'svcQ' THEN 'Y' ELSE 'N' END AS text FROM services),
 subs AS (SELECT DISTINCT 'svc' || status AS service, 's' || username AS subsystem FROM v_jobs WHERE username < '20')"""


@query("c13_service_catalog", f"WITH {SERVICES} SELECT name, command, audio, text, (SELECT string_agg(subsystem, ',' ORDER BY subsystem) FROM subs WHERE service = name) AS subsystems FROM services JOIN require USING (name)")
def c13(s, sf):
    return j.service_catalog(*_services(s, sf))


@query("c14_validate_requests", f"""WITH {SERVICES}, q AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'none' ELSE 'svc' || status END AS service, 's' || username AS subsystem, CASE WHEN event_id % 5 > 0 THEN 'a' END AS getaudio, CASE WHEN event_id % 3 > 0 THEN 't' END AS gettext FROM v_jobs)
 SELECT event_id, CASE WHEN r.name IS NULL THEN 'unknown service' WHEN audio = 'Y' AND getaudio IS NULL THEN 'no audio' WHEN text = 'Y' AND gettext IS NULL THEN 'no text' WHEN s.service IS NULL THEN 'unknown subsystem' END AS reject_reason
 FROM q LEFT JOIN require r ON q.service = name LEFT JOIN subs s ON s.service = q.service AND s.subsystem = q.subsystem""")
def c14(s, sf):
    e = v.jobs(s, sf)
    q = e.select("event_id", F.when(c("event_id") % 11 == 0, "none").otherwise(F.concat(F.lit("svc"), "status")).alias("service"), F.concat(F.lit("s"), "username").alias("subsystem"), F.when(c("event_id") % 5 > 0, "a").alias("getaudio"), F.when(c("event_id") % 3 > 0, "t").alias("gettext"))
    return j.validate_requests(q, *_services(s, sf)).select("event_id", "reject_reason")


@query("c15_score_candidates", """WITH d AS (SELECT word, array_to_string(phones, ' ') || (length(word) % 3) AS pron FROM v_lexicon), k AS (SELECT word, array_to_string(phones, ' ') || (length(word) % 2) AS pron FROM v_lexicon WHERE length(word) > 3 UNION ALL SELECT word, 'x' FROM v_lexicon WHERE length(word) < 5)
 SELECT word, pron, CASE WHEN (word, pron) IN (SELECT (word, pron) FROM d) THEN 'right' WHEN (word, regexp_replace(pron, '[0-9]', '', 'g')) IN (SELECT (word, regexp_replace(pron, '[0-9]', '', 'g')) FROM d) THEN 'partial' ELSE 'wrong' END AS grade FROM k""")
def c15(s, sf):
    lx = v.lexicon(s, sf)
    p = F.array_join("phones", " ")
    d = lx.select("word", F.concat(p, F.length("word") % 3).alias("pron"))
    k = lx.filter("length(word) > 3").select("word", F.concat(p, F.length("word") % 2).alias("pron")).unionByName(lx.filter("length(word) < 5").select("word", F.lit("x").alias("pron")))
    return j.score_candidates(k, d)


@query("c16_lexicon_lookup", "SELECT DISTINCT word, CASE WHEN length(word) BETWEEN 2 AND 6 THEN 'd ' || word WHEN length(word) BETWEEN 7 AND 9 THEN 'f ' || word ELSE '<unk>' END AS pron FROM v_words")
def c16(s, sf):
    w = v.words(s, sf).select("word").distinct()
    d = w.filter("length(word) between 2 and 6").select("word", F.concat(F.lit("d "), "word").alias("pron"))
    f = w.filter("length(word) between 7 and 9").select(F.concat(F.lit("en:"), "word").alias("word"), F.concat(F.lit("f "), "word").alias("pron"))
    return j.lexicon_lookup(w, d, f, "en")


@query("c17_unique_closure", "WITH u AS (SELECT utt, (utt::BIGINT // 3)::VARCHAR AS uniq FROM v_utt2spk) SELECT utt, uniq FROM u WHERE uniq IN (SELECT uniq FROM u WHERE utt::BIGINT % 10 = 0)")
def c17(s, sf):
    u = v.utt2spk(s, sf).select("utt", F.floor(c("utt").cast("long") / 3).cast("string").alias("uniq"))
    return j.unique_closure(u.filter("cast(utt as long) % 10 = 0"), u)
