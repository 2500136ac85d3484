"""Registered queries: time intervals."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import intervals as g, recordings as r
from . import adapters as v
from .adapters import query, table

c = F.col
ISL = "sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY start_cs, end_cs{more} ROWS UNBOUNDED PRECEDING)"


def _durations(s, sf):
    return v.labelseg(s, sf).groupBy("rec").agg((F.max("end_cs") + 1000).alias("dur_cs"))


COMP = """n AS (SELECT rec, end_cs AS a, lead(start_cs) OVER (PARTITION BY rec ORDER BY start_cs, end_cs) AS b FROM v_speechseg), d AS (SELECT rec, max(end_cs) + 1000 AS dur FROM v_labelseg GROUP BY rec),
 f AS (SELECT rec, min(start_cs) AS a, arg_max(end_cs, [start_cs, end_cs]) AS b FROM v_speechseg GROUP BY rec),
 co AS (SELECT rec, a AS start_cs, b AS end_cs FROM n WHERE b > a UNION ALL SELECT rec, 0, coalesce(a, dur) FROM d LEFT JOIN f USING (rec) WHERE coalesce(a, dur) > 0 UNION ALL SELECT rec, b, dur FROM d JOIN f USING (rec) WHERE dur > b)"""


@query("g1_complement_intervals", f"WITH {COMP} SELECT * FROM co")
def g1(s, sf):
    return g.complement(v.speechseg(s, sf).select("rec", "start_cs", "end_cs"), _durations(s, sf))


@query("g2_silences_to_segments", """WITH z AS (SELECT rec, start_cs, end_cs FROM v_touching WHERE label = 'error' AND end_cs - start_cs > 3000 AND start_cs > 0), t AS (SELECT rec, max(end_cs) AS dur FROM v_touching GROUP BY rec),
 n AS (SELECT rec, end_cs AS a, lead(start_cs) OVER (PARTITION BY rec ORDER BY start_cs, end_cs) AS b FROM z), f AS (SELECT rec, min(start_cs) AS a, max(end_cs) AS b FROM z GROUP BY rec)
 SELECT rec, start_cs, end_cs, 'SILENCE' AS kind FROM z UNION ALL SELECT rec, a, b, 'NON-SILENCE' FROM n WHERE b > a UNION ALL SELECT rec, 0, coalesce(a, dur), 'NON-SILENCE' FROM t LEFT JOIN f USING (rec) WHERE coalesce(a, dur) > 0 UNION ALL SELECT rec, b, dur, 'NON-SILENCE' FROM t JOIN f USING (rec) WHERE dur > b""")
def g2(s, sf):
    return g.silences_to_segments(v.touching(s, sf).select("rec", "start_cs", "end_cs", (c("label") != "error").alias("voiced")), 3000)


@query("g3_merge_overlaps", f"""WITH p AS (SELECT *, lag(end_cs) OVER (PARTITION BY rec ORDER BY start_cs, end_cs) AS pe FROM v_labelseg), i AS (SELECT *, {ISL.format(flag='start_cs <= pe', more='')} AS island FROM p)
 SELECT rec, island::BIGINT AS island, min(start_cs) AS start_cs, arg_max(end_cs, [start_cs, end_cs]) AS end_cs FROM i GROUP BY rec, island""")
def g3(s, sf):
    return g.merge_overlaps(v.labelseg(s, sf))


MSL = f"""p AS (SELECT *, lag(end_cs) OVER w AS pe, lag(label) OVER w AS pl FROM v_touching WINDOW w AS (PARTITION BY rec ORDER BY start_cs, end_cs, label)),
 i AS (SELECT *, {ISL.format(flag='start_cs = pe AND label = pl', more=', label')} AS island FROM p), ms AS (SELECT rec, min(start_cs) AS start_cs, max(end_cs) AS end_cs, any_value(label) AS label FROM i GROUP BY rec, island)"""


@query("g4_merge_same_label", f"WITH {MSL} SELECT * FROM ms")
def g4(s, sf):
    return g.merge_same_label(v.touching(s, sf)).drop("island")


RUN = f"""p AS (SELECT *, lag(label) OVER (PARTITION BY rec ORDER BY start_cs, end_cs, label) AS pl FROM v_touching), i AS (SELECT *, {ISL.format(flag='label = pl', more=', label')} AS run FROM p),
 ru AS (SELECT rec, label, start_cs, end_cs, event_id, run::BIGINT AS run, (sum(end_cs - start_cs) OVER (PARTITION BY rec, run))::BIGINT AS run_cs FROM i)"""


@query("g5_label_runs", f"WITH {RUN} SELECT * FROM ru")
def g5(s, sf):
    return g.label_runs(v.touching(s, sf))


@query("g6_training_speech", f"WITH {RUN}, k AS (SELECT *, sum(end_cs - start_cs) OVER (PARTITION BY rec, label) AS t FROM ru WHERE run_cs >= 500000) SELECT rec, label, start_cs, end_cs FROM k WHERE t >= 5000000")
def g6(s, sf):
    return g.select_training_speech(v.touching(s, sf), 500000, 5000000)


@query("g7_cooccurrence_merge", "SELECT rec, min(start_cs) AS start_cs, max(end_cs) AS end_cs, arg_max(label, [start_cs, end_cs]) AS label FROM v_touching GROUP BY rec")
def g7(s, sf):
    return g.cooccurrence_merge(v.touching(s, sf))


@query("g8_split_long_runs", f"""WITH {RUN}, q AS (SELECT rec, run, any_value(label) AS label, min(start_cs) AS a, arg_max(end_cs, [start_cs, end_cs]) AS b, max(start_cs) AS l, greatest(1, ceil((arg_max(end_cs, [start_cs, end_cs]) - min(start_cs)) / 6000000.0))::BIGINT AS n FROM ru GROUP BY rec, run),
 k AS (SELECT rec, run, a + (b - a) * k / n AS cut, l FROM q, range(1, 200) x(k) WHERE k < n), pt AS (SELECT k.rec, k.run, cut, coalesce(min(r.start_cs), any_value(l)) AS pt FROM k LEFT JOIN ru r ON r.rec = k.rec AND r.run = k.run AND r.start_cs > cut GROUP BY k.rec, k.run, cut),
 st AS (SELECT rec, run, a AS pt FROM q UNION SELECT rec, run, pt FROM pt)
 SELECT st.rec, label, pt AS start_cs, coalesce(lead(pt) OVER (PARTITION BY st.rec, st.run ORDER BY pt), b) AS end_cs FROM st JOIN q ON q.rec = st.rec AND q.run = st.run""")
def g8(s, sf):
    return g.split_long_runs(v.touching(s, sf), 6000000)


@query("g9_min_gap", "WITH RECURSIVE t AS (SELECT DISTINCT rec, start_cs::DOUBLE AS pt FROM v_labelseg), k AS (SELECT rec, min(pt) AS pt FROM t GROUP BY rec UNION ALL SELECT rec, (SELECT min(t.pt) FROM t WHERE t.rec = k.rec AND t.pt >= k.pt + 5000000) FROM k WHERE k.pt IS NOT NULL) SELECT rec, pt AS \"at\" FROM k WHERE pt IS NOT NULL")
def g9(s, sf):
    return g.min_gap(v.labelseg(s, sf).select("rec", c("start_cs").alias("at")), 5000000)


@query("g10_adaptive_splits", "WITH d AS (SELECT *, max(end_cs - start_cs) OVER (PARTITION BY rec) AS m FROM v_touching WHERE label = 'error'), t AS (SELECT *, CASE WHEN m > 8000000 THEN 8000000 WHEN m > 7000000 THEN 7000000 WHEN m > 6000000 THEN 6000000 END AS threshold FROM d) SELECT rec, (start_cs + end_cs) / 2 AS \"at\", threshold FROM t WHERE end_cs - start_cs > threshold")
def g10(s, sf):
    return g.adaptive_splits(v.touching(s, sf).filter("label = 'error'"), (8000000, 7000000, 6000000))


def _lengths(s, sf):
    return v.labelseg(s, sf).groupBy("rec").agg(F.floor(F.max("end_cs") / 100).alias("dur"))


LEN = "le AS (SELECT rec, max(end_cs) // 100 AS dur FROM v_labelseg GROUP BY rec)"


@query("g11_fixed_chunks", f"WITH {LEN}, d AS (SELECT *, least(100000, dur) AS d FROM le), n AS (SELECT *, greatest(1, floor(dur / d + 0.5))::BIGINT AS n FROM d), t AS (SELECT *, d + trunc((dur - d * n) / n)::BIGINT AS step FROM n) SELECT rec, k, k * step AS start, CASE WHEN k = n - 1 THEN dur ELSE (k + 1) * step END AS \"end\" FROM t, range(0, 100) x(k) WHERE k < n")
def g11(s, sf):
    return g.fixed_chunks(_lengths(s, sf), 100000)


@query("g12_overlapping_chunks", "WITH RECURSIVE k AS (SELECT event_id, start_cs AS seg_a, end_cs AS seg_b, start_cs AS a, 0 AS k FROM v_touching UNION ALL SELECT event_id, seg_a, seg_b, a + 2500000, k + 1 FROM k WHERE a + 2500000 + 1000000 < seg_b) SELECT 's' || event_id AS seg, 's' || event_id || '-' || lpad(k::VARCHAR, 5, '0') AS chunk, a AS start_cs, CASE WHEN k = max(k) OVER (PARTITION BY event_id) THEN seg_b ELSE a + 3000000 END AS end_cs FROM k")
def g12(s, sf):
    return g.overlapping_chunks(v.touching(s, sf).select(F.concat(F.lit("s"), "event_id").alias("seg"), "start_cs", "end_cs"), 3000000, 1000000, 500000)


@query("g13_equal_chunks", f"WITH {LEN} SELECT rec, k, k * (dur // 7) AS start, CASE WHEN k = 6 THEN dur ELSE (k + 1) * (dur // 7) END AS \"end\" FROM le, range(0, 7) x(k)")
def g13(s, sf):
    return g.equal_chunks(_lengths(s, sf), 7)


CHUNK = 60000000


@query("g14_merge_chunk_results", f"WITH x AS (SELECT rec, min(start_cs) AS start_cs, max(end_cs) AS end_cs, arg_min(label, event_id) AS label FROM v_touching GROUP BY rec, start_cs), f AS (SELECT rec, start_cs, end_cs, min(start_cs) OVER (PARTITION BY rec, start_cs // {CHUNK}, label) AS f FROM x) SELECT rec, 'C_' || dense_rank() OVER (PARTITION BY rec ORDER BY f) AS label, start_cs, end_cs FROM f")
def g14(s, sf):
    x = v.touching(s, sf).groupBy("rec", "start_cs").agg(F.max("end_cs").alias("end_cs"), F.min_by("label", "event_id").alias("label"))
    base = F.floor(c("start_cs") / CHUNK) * CHUNK
    x = x.withColumn("file", F.concat(F.lit("r_"), base, F.lit("-"), base + CHUNK, F.lit(".seg")))
    return g.merge_chunk_results(x.select("rec", "file", (c("start_cs") - base).alias("start_cs"), (c("end_cs") - base).alias("end_cs"), "label"))


@query("g15_relabel_with_conflicts", """WITH RECURSIVE x AS (SELECT rec, length(label) AS label, start_cs, end_cs FROM v_touching), l AS (SELECT rec, label, min(start_cs) AS first, CASE WHEN label IN (4, 5) THEN 11 - label END AS new FROM x GROUP BY rec, label),
 o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY first, label) AS rn FROM l), r AS (SELECT rec, 0::BIGINT AS rn, NULL::BIGINT AS label, NULL::BIGINT AS new, coalesce(list(new) FILTER (new IS NOT NULL), []) AS taken, greatest(max(label), coalesce(max(new), 0)) AS top FROM l GROUP BY rec
 UNION ALL SELECT rec, rn, label, n, CASE WHEN mapped THEN taken ELSE list_append(taken, n) END, greatest(top, n) FROM (SELECT o.rec, o.rn, o.label, o.new IS NOT NULL AS mapped, CASE WHEN o.new IS NOT NULL THEN o.new WHEN list_contains(r.taken, o.label) THEN r.top + 1 ELSE o.label END AS n, r.taken, r.top FROM r JOIN o ON o.rec = r.rec AND o.rn = r.rn + 1))
 SELECT x.rec, r.new AS label, start_cs, end_cs FROM x JOIN r ON r.rec = x.rec AND r.label = x.label""")
def g15(s, sf):
    x = v.touching(s, sf).withColumn("label", F.length("label").cast("long"))
    m = x.select("rec", "label").distinct().filter("label in (4, 5)").withColumn("to", 11 - c("label"))
    return g.relabel_with_conflicts(x.select("rec", "label", "start_cs", "end_cs"), m)


GAP = """b AS (SELECT *, first(model) OVER w AS best, first(score) OVER w AS top FROM v_scores WINDOW w AS (PARTITION BY rec, event_id ORDER BY score DESC, model)),
 gp AS (SELECT rec, least(model, best) AS i, greatest(model, best) AS j, sum((end_cs - start_cs) * (top - score)) / sum(end_cs - start_cs) AS gap FROM b WHERE model <> best GROUP BY ALL)"""


@query("g16_score_gap_pairs", f"WITH {GAP} SELECT rec, i, j, round(gap, 6) AS gap FROM gp")
def g16(s, sf):
    return g.score_gap_pairs(v.scores(s, sf)).withColumn("gap", F.round("gap", 6))


@query("g16_cluster_labels", f"""WITH RECURSIVE {GAP}, e AS (SELECT rec, i AS a, j AS b FROM gp WHERE gap < 4 UNION SELECT rec, j, i FROM gp WHERE gap < 4), l AS (SELECT rec, i AS label FROM gp UNION SELECT rec, j FROM gp),
 r AS (SELECT rec, label, label AS m FROM l UNION SELECT r.rec, r.label, e.b FROM r JOIN e ON e.rec = r.rec AND e.a = r.m) SELECT rec, label, min(m) AS canonical FROM r GROUP BY rec, label""")
def g16b(s, sf):
    return g.cluster_labels(g.score_gap_pairs(v.scores(s, sf)), 4.0)


@query("g17_smooth_scores", """WITH n AS (SELECT a.rec, a.event_id, a.model, sum(w * o_score) / sum(w) AS m FROM (SELECT a.rec, a.event_id, a.model, least(b.end_cs, a.end_cs + 500000) - greatest(b.start_cs, a.start_cs - 500000) AS w, b.score AS o_score FROM v_scores a JOIN v_scores b ON a.rec = b.rec AND a.model = b.model AND a.event_id <> b.event_id) a WHERE w > 0 GROUP BY ALL)
 SELECT rec, event_id, model, round(s.score + 0.5 * coalesce(m, 0), 6) AS score FROM v_scores s LEFT JOIN n USING (rec, event_id, model)""")
def g17(s, sf):
    return g.smooth_scores(v.scores(s, sf), 500000, 0.5).withColumn("score", F.round("score", 6))


@query("g18_duration_folds", "WITH d AS (SELECT *, end_cs - start_cs AS d FROM v_labelseg), t AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY rec, label ORDER BY start_cs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(d) OVER (PARTITION BY rec, label) AS t FROM d) SELECT rec, label, event_id, CASE WHEN t > 0 THEN least(9, floor(b * 10 / t))::BIGINT ELSE 0 END AS fold FROM t")
def g18(s, sf):
    return g.duration_folds(v.labelseg(s, sf)).select("rec", "label", "event_id", "fold")


@query("g18_greedy_folds", """WITH RECURSIVE o AS (SELECT rec, label, event_id, end_cs - start_cs AS x, row_number() OVER w AS rn, (sum(end_cs - start_cs) OVER (PARTITION BY rec, label))::DOUBLE / 10 AS want FROM v_labelseg WINDOW w AS (PARTITION BY rec, label ORDER BY start_cs, event_id)),
 r AS (SELECT rec, label, event_id, rn, 0 AS fold, (x >= want)::INT AS nxt, CASE WHEN x >= want THEN 0 ELSE x END AS have FROM o WHERE rn = 1
  UNION ALL SELECT rec, label, event_id, rn, fold, fold + done::INT, CASE WHEN done THEN 0 ELSE total END FROM (SELECT *, total >= want AND fold < 9 AS done FROM (SELECT *, nxt + early::INT AS fold, CASE WHEN early THEN 0 ELSE have END + x AS total FROM
   (SELECT o.*, r.nxt, r.have, r.have <> 0 AND r.nxt < 9 AND r.have + o.x > o.want AND o.want - r.have < r.have + o.x - o.want AS early FROM r JOIN o ON o.rec = r.rec AND o.label = r.label AND o.rn = r.rn + 1))))
 SELECT rec, label, event_id, fold FROM r""")
def g18b(s, sf):
    return g.greedy_folds(v.labelseg(s, sf))


@query("g19_fill_ctm_gaps", """WITH t AS (SELECT *, lag(start + dur, 1, 0.0::DOUBLE) OVER (PARTITION BY utt ORDER BY start, dur, word) AS e FROM v_ctm) SELECT utt, channel, start, dur, word FROM v_ctm UNION ALL SELECT utt, channel, round(e, 2), round(start - e, 2), '<eps>' FROM t WHERE start > e + 0.05""")
def g19(s, sf):
    return g.fill_ctm_gaps(v.ctm(s, sf))


@query("g20_segments_of_aligned")
def g20(s, sf):
    p = v.pairs(s, sf).filter("k = 0").select("utt", "pos", (c("pos") * 0.4).alias("start"), F.lit(0.4).alias("dur"), "ref", "hyp")
    pause = (c("pos") % 9 == 0)
    return g.segments_of_aligned(p.withColumn("dur", F.when(pause, 0.6).otherwise(c("dur"))).withColumn("ref", F.when(pause, "<eps>").otherwise(c("ref"))).withColumn("hyp", F.when(pause, "<eps>").otherwise(c("hyp"))))


@query("g21_rec_transcript", "SELECT utt, string_agg(word, ' ' ORDER BY start, pos) AS text FROM v_ctm GROUP BY utt")
def g21(s, sf):
    return g.transcript(v.ctm(s, sf))


@query("g22_energy_speech", """WITH f AS (SELECT user_id::VARCHAR AS rec, value AS rms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 20 AS frame FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY rms, frame) AS lo, row_number() OVER (PARTITION BY rec ORDER BY rms DESC, frame) AS hi FROM f),
 t AS (SELECT rec, avg(rms) FILTER (lo <= 10) AS lo, avg(rms) FILTER (hi <= 10) AS hi FROM r GROUP BY rec), l AS (SELECT f.*, lag(frame) OVER (PARTITION BY rec ORDER BY frame) AS p FROM f JOIN t USING (rec) WHERE rms >= lo + (hi - lo) / 3), i AS (SELECT *, sum(CASE WHEN frame - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY frame) AS island FROM l)
 SELECT rec, island::BIGINT AS island, min(frame) AS first, max(frame) AS last, count(*) AS loud FROM i GROUP BY rec, island""")
def g22(s, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 20
    return g.energy_speech(table(s, sf, "events").select(c("user_id").cast("string").alias("rec"), c("value").alias("rms"), n.alias("frame")), 50, 10)


@query("g23_html_time_segments", """WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '</p>', '</p><time type="mark" datetime="2.5"></time>') AS html FROM pages), x AS (SELECT page_id, string_split(html, '<time type="mark" datetime="2.5"></time>') AS p FROM h)
 SELECT page_id, i AS seq, CASE WHEN i = 0 THEN 0.0 ELSE 2.5 END::DOUBLE AS start, CASE WHEN i = 0 AND len(p) > 1 THEN 2.5 END::DOUBLE AS "end", trim(regexp_replace(regexp_replace(p[i + 1], '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM x, range(0, 2) r(i) WHERE i < len(p)""")
def g23(s, sf):
    h = F.coalesce("html", F.lit(""))
    at = F.instr(h, "</p>")
    marked = F.when(at > 0, F.concat(F.substring(h, F.lit(1), at + 3), F.lit('<time type="mark" datetime="2.5"></time>'), F.substring(h, at + 4, F.length(h)))).otherwise(h)
    return g.html_time_segments(table(s, sf, "pages").select("page_id", marked.alias("html")))


@query("g24_recognizable_gaps", "WITH t AS (SELECT DISTINCT rec, start_cs FROM v_labelseg), m AS (SELECT rec, start_cs, lead(start_cs) OVER (PARTITION BY rec ORDER BY start_cs) AS end_cs FROM t) SELECT rec, start_cs, end_cs, CASE WHEN start_cs % 3 = 0 THEN 'sil' WHEN end_cs - start_cs > 4000000 THEN 'too long' WHEN end_cs - start_cs < 500000 THEN 'too short' ELSE 'speech' END AS kind FROM m WHERE end_cs IS NOT NULL")
def g24(s, sf):
    m = v.labelseg(s, sf).select("rec", "start_cs").distinct().withColumn("has_text", c("start_cs") % 3 == 0)
    return g.recognizable_gaps(m, 4000000, 500000)


@query("g25_perturb_speed", "SELECT 'sp0.9-' || utt AS utt, 'sp0.9-' || rec AS rec, round(start / 0.9::DOUBLE, 2) AS start, round(\"end\" / 0.9::DOUBLE, 2) AS \"end\", utt AS uniq FROM v_segments")
def g25(s, sf):
    return g.perturb_speed(v.segments(s, sf), 0.9)


@query("g26_append_utterances", "WITH r AS (SELECT spk, utt::BIGINT AS n, array_to_string(words, ' ') AS t, (row_number() OVER (PARTITION BY spk ORDER BY utt::BIGINT) - 1) // 100 AS part FROM v_text JOIN v_utt2spk USING (utt)) SELECT spk, part, string_agg(t, ' ' ORDER BY n) AS text FROM r GROUP BY spk, part")
def g26(s, sf):
    t = v.text(s, sf).join(v.utt2spk(s, sf), "utt").select("spk", c("utt").cast("long").alias("n"), F.array_join("words", " ").alias("text"))
    return g.append_utterances(t, 100)


@query("g27_phone_class_runs", "WITH k AS (SELECT utt, pos, CASE WHEN word[1] IN ('a','e','i','o','u') THEN 1 ELSE 0 END AS class FROM v_words), p AS (SELECT *, lag(class) OVER (PARTITION BY utt ORDER BY pos) AS pc FROM k), i AS (SELECT *, sum(CASE WHEN class = pc THEN 0 ELSE 1 END) OVER (PARTITION BY utt ORDER BY pos) AS island FROM p) SELECT utt, island::BIGINT AS island, any_value(class) AS class, min(pos) AS first, count(*) AS n FROM i GROUP BY utt, island")
def g27(s, sf):
    f = v.words(s, sf).select("utt", c("pos").alias("frame"), F.substring("word", 1, 1).alias("phone"))
    k = s.createDataFrame([(chr(x), int(chr(x) in "aeiou")) for x in range(97, 123)], "phone string, class int")
    return g.phone_class_runs(f, k)


@query("g17_smooth_labels")
def g17_labels(s, sf):
    """Scores smoothed in place, and labels of little speech discarded until none is left."""
    return r.smooth_and_discard(v.scores(s, sf).select("rec", "event_id", "start_cs", "end_cs", "model", "score"), 500000, 0.5, 8_000_000)


SPLICED = """s AS (SELECT utt, channel, k * 1000 + pos AS p, CASE WHEN k > 0 AND pos <= 8 * k + 2 AND pos % 5 = 0 THEN 'zz' ELSE word END AS w, CASE WHEN k > 0 AND pos <= 8 * k + 2 AND pos % 3 = 0 THEN round(start + 0.01, 2) ELSE start END AS s, dur AS d
 FROM (SELECT *, unnest([(pos - 1) // 8, (pos - 1) // 8 - 1]) AS k FROM v_ctm) WHERE k >= 0 AND pos <= 8 * k + 10)"""


def _overlapping(s, sf):
    """Words in stretches of ten, of which two repeat the end of the stretch before; some repeats are a little late, some are other words."""
    x = v.ctm(s, sf).withColumn("k", F.explode(F.array(F.floor((c("pos") - 1) / 8), F.floor((c("pos") - 1) / 8) - 1))).filter((c("k") >= 0) & (c("pos") <= 8 * c("k") + 10))
    again = (c("k") > 0) & (c("pos") <= 8 * c("k") + 2)
    word = F.when(again & (c("pos") % 5 == 0), "zz").otherwise(c("word"))
    start = F.when(again & (c("pos") % 3 == 0), F.round(c("start") + 0.01, 2)).otherwise(c("start"))
    return x.select("utt", "channel", (c("k") * 1000 + c("pos")).alias("pos"), start.alias("start"), "dur", word.alias("word"))


@query("g19_splice_repeats", f"""WITH RECURSIVE {SPLICED}, o AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY p) AS rn FROM s),
 r AS (SELECT utt, channel, rn, [{{'s': s, 'd': d, 'w': w}}] AS kept FROM o WHERE rn = 1 UNION ALL SELECT utt, channel, rn,
  CASE WHEN e = s THEN list_append(kept, {{'s': s, 'd': d, 'w': w}}) WHEN e < s THEN list_concat(kept, [{{'s': e, 'd': round(s - e, 2), 'w': '<eps>'}}, {{'s': s, 'd': d, 'w': w}}])
  ELSE kept[1:coalesce(list_max(list_filter(range(stop + 1, len(kept) + 1), lambda i: kept[i].w = w AND abs(kept[i].s - s) < 0.05 AND abs(kept[i].d - d) < 0.05)), len(kept))] END
  FROM (SELECT o.*, r.kept, round(r.kept[-1].s + r.kept[-1].d, 2) AS e, coalesce(list_max(list_filter(range(1, len(r.kept) + 1), lambda i: r.kept[i].s + r.kept[i].d <= o.s)), 0) AS stop FROM r JOIN o ON o.utt = r.utt AND o.rn = r.rn + 1))
 SELECT utt, channel, x.s AS start, x.d AS dur, x.w AS word FROM (SELECT utt, channel, unnest(kept) AS x FROM (SELECT *, max(rn) OVER (PARTITION BY utt) AS last FROM r) WHERE rn = last)""")
def g19_splice(s, sf):
    return r.splice_ctm(_overlapping(s, sf))


@query("g20_cut_aligned")
def g20_cut(s, sf):
    """Conversations as recordings: every ninth word is a pause; some words are heard wrongly, some are too many, some missing."""
    w = v.ctm(s, sf).select(F.split("utt", "-")[0].alias("utt"), F.split("utt", "-")[1].cast("int").alias("turn"), "pos", "word")
    n = F.row_number().over(Window.partitionBy("utt").orderBy("turn", "pos"))
    w = w.select("utt", n.cast("long").alias("pos"), "word")
    pause = c("pos") % 9 == 0
    ctm = w.select("utt", "pos", (c("pos") * 0.7).alias("start"), F.when(pause, 0.3 + (c("pos") % 4) / 10).otherwise(0.6).alias("dur"), F.when(pause, "<eps>").otherwise(c("word")).alias("word"))
    said = w.filter(~pause)
    ref = F.when(c("pos") % 41 == 0, F.concat(F.lit("zz"), "word")).when(c("pos") % 53 == 0, "<eps>").otherwise(c("word"))
    pairs = said.select("utt", (c("pos") * 2).alias("pos"), ref.alias("ref"), c("word").alias("hyp"))
    missing = said.filter("pos % 37 = 0").select("utt", (c("pos") * 2 + 1).alias("pos"), c("word").alias("ref"), F.lit("<eps>").alias("hyp"))
    return r.cut_aligned(ctm, pairs.unionByName(missing), wer_cutoff=0.5)


@query("g22_energy_states", """WITH RECURSIVE f AS (SELECT user_id::VARCHAR AS rec, event_id, value AS rms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 w AS (SELECT rec, frame, rms, -1 AS win FROM f UNION ALL SELECT rec, frame, rms, frame // 20 FROM f WHERE frame < n - 1), k AS (SELECT *, row_number() OVER (PARTITION BY rec, win ORDER BY rms DESC, frame) AS k, count(*) OVER (PARTITION BY rec, win) AS size FROM w),
 lv AS (SELECT rec, win, avg(rms) AS top FROM k WHERE (k > 1 OR size = 1) AND k <= 6 AND (win <= 0 OR size > 8) GROUP BY rec, win),
 r AS (SELECT a.rec, -1::BIGINT AS frame, 0 AS st, false AS due, 0::BIGINT AS win, greatest(coalesce(b.top, a.top), 0.2 * a.top) / 3 AS lim, 0::BIGINT AS first, 0::BIGINT AS below, false AS closed, a.top AS whole FROM lv a LEFT JOIN lv b ON b.rec = a.rec AND b.win = 0 WHERE a.win = -1
 UNION ALL SELECT rec, frame, CASE st WHEN 0 THEN loud::INT WHEN 1 THEN 2 - loud::INT ELSE CASE WHEN loud THEN 1 WHEN frame - below > 2 THEN 0 ELSE 2 END END, due AND NOT change, win + change::INT, lim, CASE WHEN st = 0 AND loud THEN frame ELSE first END,
  CASE WHEN st = 1 AND NOT loud THEN frame ELSE below END, st = 2 AND NOT loud AND frame - below > 2, whole FROM (SELECT *, rms >= lim AS loud FROM (SELECT x.rec, f.frame, f.rms, x.st, x.due OR f.frame % 20 = 0 AS due, x.st = 0 AND (x.due OR f.frame % 20 = 0) AS change, x.win, x.first, x.below, x.whole,
  CASE WHEN x.st = 0 AND (x.due OR f.frame % 20 = 0) AND lv.top IS NOT NULL THEN greatest(lv.top, 0.2 * x.whole) / 3 ELSE x.lim END AS lim FROM r x JOIN f ON f.rec = x.rec AND f.frame = x.frame + 1 LEFT JOIN lv ON lv.rec = x.rec AND lv.win = x.win + 1))),
 spans AS (SELECT rec, first, below AS last FROM r WHERE closed UNION ALL SELECT rec, first, frame FROM (SELECT *, max(frame) OVER (PARTITION BY rec) AS e FROM r) WHERE frame = e AND st > 0)
 SELECT rec, first, last FROM spans s WHERE (SELECT count(*) FROM f WHERE f.rec = s.rec AND f.frame >= s.first AND f.frame < s.last AND f.event_id % 3 = 0) > 0.1 * (last - first)""")
def g22_states(s, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    frames = table(s, sf, "events").select(c("user_id").cast("string").alias("rec"), n.cast("long").alias("frame"), c("value").alias("rms"), (c("event_id") % 3 == 0).cast("int").alias("pitch"))
    return r.pitched(r.energy_states(frames, 20, 5, 8, 2), frames, 0.1, 20)


def _generated(s, rows, view: str, call: str):
    """Rows that a table function makes of a view of ``rows``, through SQL."""
    from ..functions import generators

    generators.register(s)
    rows.createOrReplaceTempView(view)
    return s.sql(f"SELECT * FROM {call}")


@query("g9_table_function", same_as="g9_min_gap")
def g9_udtf(s, sf):
    points = v.labelseg(s, sf).select("rec", c("start_cs").cast("double").alias("at")).distinct()
    return _generated(s, points, "parlance_points", "min_gap(TABLE(parlance_points), 5000000D)")


@query("g11_table_function", same_as="g11_fixed_chunks")
def g11_udtf(s, sf):
    return _generated(s, _lengths(s, sf), "parlance_lengths", "fixed_chunks(TABLE(parlance_lengths), 100000)")


@query("g12_table_function", same_as="g12_overlapping_chunks")
def g12_udtf(s, sf):
    rows = v.touching(s, sf).select(F.concat(F.lit("s"), "event_id").alias("seg"), "start_cs", "end_cs")
    return _generated(s, rows, "parlance_segments", "overlapping_chunks(TABLE(parlance_segments), 3000000, 1000000, 500000)")


@query("g13_table_function", same_as="g13_equal_chunks")
def g13_udtf(s, sf):
    return _generated(s, _lengths(s, sf), "parlance_lengths", "equal_chunks(TABLE(parlance_lengths), 7)")


@query("g2_no_data", """WITH z AS (SELECT rec, start_cs, end_cs FROM v_touching WHERE rec::BIGINT % 4 > 0 AND label = 'error' AND end_cs - start_cs > 3000 AND start_cs > 0), t AS (SELECT rec, max(end_cs) AS dur FROM v_touching WHERE rec::BIGINT % 4 > 0 GROUP BY rec),
 n AS (SELECT rec, end_cs AS a, lead(start_cs) OVER (PARTITION BY rec ORDER BY start_cs, end_cs) AS b FROM z), f AS (SELECT rec, min(start_cs) AS a, max(end_cs) AS b FROM z GROUP BY rec)
 SELECT rec, start_cs, end_cs, 'SILENCE' AS kind FROM z UNION ALL SELECT rec, a, b, 'NON-SILENCE' FROM n WHERE b > a UNION ALL SELECT rec, 0, coalesce(a, dur), 'NON-SILENCE' FROM t LEFT JOIN f USING (rec) WHERE coalesce(a, dur) > 0 UNION ALL SELECT rec, b, dur, 'NON-SILENCE' FROM t JOIN f USING (rec) WHERE dur > b
 UNION ALL SELECT DISTINCT rec, NULL::BIGINT, NULL::BIGINT, 'NO-DATA' FROM v_labelseg WHERE rec NOT IN (SELECT rec FROM t)""")
def g2_empty(s, sf):
    heard = v.touching(s, sf).filter(c("rec").cast("long") % 4 > 0).select("rec", "start_cs", "end_cs", (c("label") != "error").alias("voiced"))
    return g.silences_to_segments(heard, 3000, v.labelseg(s, sf).select("rec"))
