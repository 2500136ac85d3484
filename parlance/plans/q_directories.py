"""Registered queries: upkeep of corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import directories as d
from . import adapters as v
from .adapters import query

c = F.col


def _corpus(s, sf):
    """Utterances of the documents with recordings, some tables incomplete."""
    u = v.utt2spk(s, sf)
    n = c("utt").cast("long")
    return {
        "utt2spk": u,
        "text": v.text(s, sf).filter(n % 11 > 0),
        "segments": u.select("utt", F.concat(F.lit("r"), F.floor(n / 10)).alias("rec"), (n % 10 * 5.0).alias("start"), (n % 10 * 5.0 + F.when(n % 17 == 0, 0.0).otherwise(4.0)).alias("end")),
        "wav": u.select(F.concat(F.lit("r"), F.floor(n / 10)).alias("rec")).distinct().filter("rec not like '%7'"),
        "spk2gender": u.select("spk").distinct().withColumn("gender", F.when(F.length("spk") == 4, "f").otherwise("m")).filter("spk <> 'src3'"),
    }


CORPUS = "sg AS (SELECT utt, 'r' || (utt::BIGINT // 10) AS rec FROM v_utt2spk), fx AS (SELECT utt, spk FROM v_utt2spk JOIN sg USING (utt) WHERE utt::BIGINT % 11 > 0 AND utt IN (SELECT utt FROM v_text) AND rec NOT LIKE '%7' AND spk <> 'src3')"


@query("p1_combine", "SELECT utt, spk FROM v_utt2spk UNION ALL SELECT 'b-' || utt, 'b-' || spk FROM v_utt2spk")
def p1(s, sf):
    from ..operators.maps import rename_ids

    a = {"utt2spk": v.utt2spk(s, sf)}
    b = {"utt2spk": rename_ids(v.utt2spk(s, sf), ["utt", "spk"], "b-"), "text": v.text(s, sf)}
    return d.combine(a, b)["utt2spk"]


@query("p2_subset_by_speakers", f"WITH {CORPUS} SELECT DISTINCT rec FROM sg JOIN v_utt2spk USING (utt) WHERE spk IN ('src1', 'src2') AND rec NOT LIKE '%7'")
def p2(s, sf):
    t = _corpus(s, sf)
    return d.subset(t, speakers=t["utt2spk"].filter("spk in ('src1', 'src2')"))["wav"]


@query("p3_fix", f"WITH {CORPUS} SELECT utt, spk FROM fx")
def p3(s, sf):
    return d.fix(_corpus(s, sf))["utt2spk"]


@query("p4_validate", f"""WITH {CORPUS} SELECT 'text: missing' AS "check", utt AS key FROM v_utt2spk WHERE utt::BIGINT % 11 = 0 OR utt NOT IN (SELECT utt FROM v_text) UNION ALL SELECT 'spk2gender: missing', 'src3' UNION ALL SELECT 'segments: times', utt FROM v_utt2spk WHERE utt::BIGINT % 17 = 0""")
def p4(s, sf):
    return d.validate(_corpus(s, sf))


@query("p4_validate_lines", """WITH l AS (SELECT utt, spk, row_number() OVER (ORDER BY utt::BIGINT) AS pos FROM v_utt2spk), o AS (SELECT *, lag(utt) OVER (ORDER BY pos) AS u, lag(spk) OVER (ORDER BY pos) AS s FROM l)
 SELECT 'utt2spk: not sorted by utt' AS "check", utt AS key FROM o WHERE utt < u UNION ALL SELECT 'utt2spk: not sorted by spk', utt FROM o WHERE spk < s UNION ALL SELECT DISTINCT 'spk2gender: gender', spk FROM v_utt2spk WHERE right(spk, 1) = '2'
 UNION ALL SELECT 'spk2warp: warp factor', spk FROM v_utt2spk GROUP BY spk HAVING count(*) % 2 = 0 UNION ALL SELECT 'spk2warp: no such speaker', 'ghost' UNION ALL SELECT 'spk2utt: missing', utt FROM v_utt2spk WHERE utt::BIGINT % 13 = 0 UNION ALL SELECT 'spk2utt: not in utt2spk', 'extra'""")
def p4_lines(s, sf):
    u = v.utt2spk(s, sf)
    from ..operators.helpers import numbered

    lines = numbered(u.withColumn("_k", c("utt").cast("long")), ["_k"], "pos").drop("_k")
    gender = u.select("spk").distinct().withColumn("gender", F.when(F.substring("spk", -1, 1) == "2", "x").otherwise("m"))
    warp = u.groupBy("spk").agg(F.when(F.count("*") % 2 == 0, 1.5).otherwise(1.0).alias("warp")).unionByName(s.createDataFrame([("ghost", 1.0)], "spk string, warp double"))
    utts = u.filter(c("utt").cast("long") % 13 != 0).select("utt", "spk").unionByName(u.agg(F.min("spk").alias("spk")).select(F.lit("extra").alias("utt"), "spk"))
    return d.validate_lines({"utt2spk": lines, "spk2gender": gender, "spk2warp": warp, "spk2utt": utts.groupBy("spk").agg(F.collect_list("utt").alias("utts"))})


@query("p5_validate_lexicon", """SELECT 'unknown phone' AS "check", 'q' AS key UNION ALL SELECT 'phone in both sets', 'z' UNION ALL SELECT 'empty pronunciation', 'void' UNION ALL SELECT 'probability', word FROM v_lexicon WHERE length(word) = 11 UNION ALL SELECT 'repeated entry', word FROM v_lexicon WHERE length(word) = 2""")
def p5(s, sf):
    lx = v.lexicon(s, sf).withColumn("prob", F.when(F.length("word") == 11, 1.5).otherwise(0.5))
    lx = lx.unionByName(lx.filter("length(word) = 2")).unionByName(s.createDataFrame([("void", [], 1.0), ("quiz", ["q", "z"], 1.0)], "word string, phones array<string>, prob double"))
    non = s.createDataFrame([(x,) for x in "abcdefghijklmnoprstuvwxyz"], "phone string")
    return d.validate_lexicon(lx, s.createDataFrame([("sil",), ("z",)], "phone string"), non)


@query("p6_dedup_hits", """WITH RECURSIVE o AS (SELECT kwid, file, channel, tbeg, dur, score, row_number() OVER (PARTITION BY kwid, file, channel ORDER BY tbeg, dur DESC, score DESC) AS rn FROM v_hits),
 r AS (SELECT *, tbeg AS anchor FROM o WHERE rn = 1 UNION ALL SELECT o.*, CASE WHEN o.tbeg - r.anchor >= 0.5::DOUBLE THEN o.tbeg ELSE r.anchor END FROM r JOIN o ON o.kwid = r.kwid AND o.file = r.file AND o.channel = r.channel AND o.rn = r.rn + 1)
 SELECT kwid, file, channel, tbeg, dur, score FROM (SELECT *, row_number() OVER (PARTITION BY kwid, file, channel, anchor ORDER BY score DESC, dur DESC, tbeg) AS k FROM r) WHERE k = 1""")
def p6(s, sf):
    return d.dedup_hits(v.hits(s, sf))


@query("p6_dedup_hits_chained", """WITH p AS (SELECT *, lag(tbeg) OVER w AS pt FROM v_hits WINDOW w AS (PARTITION BY kwid, file, channel ORDER BY tbeg, dur, score)), i AS (SELECT *, sum(CASE WHEN tbeg - pt < 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY kwid, file, channel ORDER BY tbeg, dur, score ROWS UNBOUNDED PRECEDING) AS island FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY kwid, file, channel, island ORDER BY score DESC, dur DESC, tbeg) AS n FROM i) SELECT kwid, file, channel, tbeg, dur, score FROM k WHERE n = 1""")
def p6b(s, sf):
    return d.dedup_hits_chained(v.hits(s, sf))


@query("p7_split_rows", "SELECT utt, spk, ntile(7) OVER (ORDER BY utt) AS part FROM v_utt2spk")
def p7(s, sf):
    return d.split_rows(v.utt2spk(s, sf), 7, "utt")


@query("p7_split_speakers_evenly", "WITH k AS (SELECT spk, row_number() OVER (ORDER BY spk) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT spk FROM v_utt2spk)) SELECT utt, spk, i * 6 // m + 1 AS part FROM v_utt2spk JOIN k USING (spk)")
def p7b(s, sf):
    return d.split_speakers_evenly(v.utt2spk(s, sf), 6)


@query("p7_balance_parts")
def p7c(s, sf):
    return d.balance_parts(v.labelseg(s, sf).groupBy(c("rec").alias("spk")).agg(F.count("*").alias("n_utts")), 8)


@query("p5_lexicon_pair", """SELECT 'not weighted' AS "check", word AS key FROM v_lexicon WHERE length(word) = 12 UNION ALL SELECT 'only weighted', word FROM v_lexicon WHERE length(word) = 2 UNION ALL SELECT 'weight', word FROM v_lexicon WHERE length(word) = 11
 UNION ALL SELECT 'phone name', unnest(['a_B', 'x#1', 'sil_'])""")
def p5_pair(s, sf):
    lx = v.lexicon(s, sf)
    heavy = lx.filter("length(word) <> 12").withColumn("prob", F.when(F.length("word") == 11, 1.5).otherwise(0.5)).withColumn("sil", F.lit(1.2))
    heavy = heavy.unionByName(heavy.filter("length(word) = 2"))  # each of these twice
    return d.validate_lexicon_pair(lx, heavy, s.createDataFrame([(x,) for x in ("a", "a_B", "x#1", "sil_", "a_b")], "phone string"))


@query("p8_heldout_by_utterance", """WITH n AS (SELECT *, row_number() OVER (ORDER BY spk, utt) AS n FROM v_utt2spk), e AS (SELECT n, spk, lead(spk) OVER (ORDER BY n) AS x FROM n)
 SELECT utt, spk, CASE WHEN n <= (SELECT coalesce(max(n), 0) FROM e WHERE (x IS NULL OR x <> spk) AND n <= (SELECT count(*) - count(*) * 10 // 100 FROM n)) THEN 'train' ELSE 'cv' END AS part FROM n""")
def p8_utterance(s, sf):
    return d.heldout_by_utterance(v.utt2spk(s, sf), 10, ["spk", "utt"])


@query("p8_heldout_by_speaker", "WITH n AS (SELECT rec AS spk, count(*) AS n FROM v_labelseg GROUP BY rec), b AS (SELECT spk, coalesce(sum(n) OVER (ORDER BY md5('777|' || spk), spk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT event_id::VARCHAR AS utt, rec AS spk, CASE WHEN b < (SELECT count(*) FROM v_labelseg) * 10.0 / 100 THEN 'cv' ELSE 'train' END AS part FROM v_labelseg JOIN b ON spk = rec")
def p8(s, sf):
    return d.heldout_by_speaker(v.labelseg(s, sf).select(c("event_id").cast("string").alias("utt"), c("rec").alias("spk")), 10.0)


@query("p9_speakers_until", "WITH n AS (SELECT spk, count(*) AS n FROM v_utt2spk GROUP BY spk), b AS (SELECT spk, coalesce(sum(n) OVER (ORDER BY md5('777|' || spk), spk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT utt, spk FROM v_utt2spk JOIN b USING (spk) WHERE b < 300")
def p9(s, sf):
    return d.speakers_until(v.utt2spk(s, sf), 300)


@query("p10_n_per_speaker", "WITH r AS (SELECT utt, spk, row_number() OVER (PARTITION BY spk ORDER BY utt) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY spk) // 7) AS s FROM v_utt2spk) SELECT utt, spk FROM r WHERE r % s = 0 AND r < 7 * s")
def p10(s, sf):
    return d.n_per_speaker(v.utt2spk(s, sf), 7).select("utt", "spk")


@query("p11_kfold", "SELECT utt, spk, (row_number() OVER (ORDER BY md5('777|' || utt), utt) - 1) % 10 AS fold FROM v_utt2spk")
def p11(s, sf):
    return d.kfold(v.utt2spk(s, sf), 10, "utt")


@query("p12_prefix_subset", "SELECT utt, spk FROM v_utt2spk WHERE utt LIKE '1%' OR utt LIKE '77%'")
def p12(s, sf):
    return d.prefix_subset(v.utt2spk(s, sf), s.createDataFrame([("1",), ("12",), ("77",)], "prefix string"), "utt")


@query("p14_training_shards", "WITH r AS (SELECT utt, row_number() OVER (ORDER BY md5('777|' || utt), utt) AS n FROM v_utt2spk) SELECT utt, CASE WHEN n <= 100 THEN 'valid' WHEN n <= 200 THEN 'train_diagnostic' ELSE 'train' END AS role, CASE WHEN n > 100 THEN (n - 101) % 4 + 1 END AS job, CASE WHEN n > 100 THEN (n - 101) // 4 % 5 END AS iter FROM r")
def p14(s, sf):
    return d.training_shards(v.utt2spk(s, sf).select("utt"), 100, 100, 4, 5)


@query("p15_relabel", "SELECT utt, pos AS frame, CASE WHEN pos % 3 = 0 THEN 'new' ELSE word END AS label FROM v_words")
def p15(s, sf):
    e = v.words(s, sf).select("utt", c("pos").alias("frame"), c("word").alias("label"))
    return d.relabel(e, e.filter("frame % 3 = 0").withColumn("label", F.lit("new")))


@query("p16_heldout_split", "SELECT utt, row_number() OVER (ORDER BY utt) <= 200 AS heldout FROM v_text")
def p16(s, sf):
    from ..operators.helpers import numbered

    return numbered(v.text(s, sf).select("utt"), ["utt"], "_n").select("utt", (c("_n") <= 200).alias("heldout"))


@query("p17_upsert", "SELECT jobid, CASE WHEN event_id % 5 = 0 THEN 'U' || username ELSE username END AS username, status FROM v_jobs WHERE event_id % 7 > 0 UNION ALL SELECT 'new' || event_id, username, 'P' FROM v_jobs WHERE event_id % 100 = 0")
def p17(s, sf):
    j = v.jobs(s, sf)
    no = F.lit(None).cast("string")
    ch = j.filter("event_id % 5 = 0 or event_id % 7 = 0").select("jobid", F.when(c("event_id") % 5 == 0, F.concat(F.lit("U"), "username")).alias("username"), no.alias("status"), (c("event_id") % 7 == 0).alias("gone"))
    ch = ch.unionByName(j.filter("event_id % 100 = 0").select(F.concat(F.lit("new"), "event_id").alias("jobid"), "username", F.lit("P").alias("status"), F.lit(False).alias("gone")))
    return d.upsert(j.select("jobid", "username", "status"), ch, "jobid", "gone")


@query("p17_job_action", "SELECT jobid, CASE WHEN event_id % 4 = 0 THEN 'X' WHEN event_id % 4 = 1 AND status = 'E' THEN 'P' ELSE status END AS status, CASE WHEN event_id % 4 <> 2 THEN errstatus END AS errstatus FROM v_jobs")
def p17b(s, sf):
    j = v.jobs(s, sf)
    k = c("event_id") % 4
    return d.job_action(j.select("jobid", "status", "errstatus"), j.filter(k < 3).select("jobid", F.when(k == 0, "delete").when(k == 1, "resubmit").otherwise("clear").alias("action")))


@query("p18_cut_speakers", "SELECT utt, spk, spk || '-' || lpad(printf('%x', (row_number() OVER (PARTITION BY spk ORDER BY utt) - 1) // 4 + 1), 6, '0') AS sub FROM v_utt2spk")
def p18(s, sf):
    return d.cut_speakers(v.utt2spk(s, sf), 4)


@query("p19_sub_speakers_by_size", """WITH RECURSIVE o AS (SELECT utt, spk, len(words) AS n, row_number() OVER (PARTITION BY spk ORDER BY utt) AS rn, sum(len(words)) OVER (PARTITION BY spk) AS total FROM v_text JOIN v_utt2spk USING (utt)),
 r AS (SELECT utt, spk, n, rn, n AS have, total - n AS rest, 0 AS k FROM o WHERE rn = 1
  UNION ALL SELECT o.utt, o.spk, o.n, o.rn, CASE WHEN have >= 2000 AND rest >= 2000 THEN 0 ELSE have END + o.n, rest - o.n, k + (have >= 2000 AND rest >= 2000)::INT FROM r JOIN o ON o.spk = r.spk AND o.rn = r.rn + 1)
 SELECT utt, spk, n, spk || '-' || printf('%06x', k) AS sub FROM r""")
def p19(s, sf):
    t = v.text(s, sf).join(v.utt2spk(s, sf), "utt").select("utt", "spk", F.size("words").cast("long").alias("n"))
    return d.sub_speakers_by_size(t, 2000)


@query("p20_whole_speakers", "SELECT event_id::VARCHAR AS utt, rec AS spk FROM v_labelseg WHERE rec IN (SELECT rec FROM v_labelseg WHERE event_id % 500 = 0)")
def p20(s, sf):
    u = v.labelseg(s, sf).select(c("event_id").cast("string").alias("utt"), c("rec").alias("spk"))
    return d.whole_speakers(u.filter("cast(utt as long) % 500 = 0"), u)


@query("p21_subset_by_attribute", "SELECT utt, spk FROM v_utt2spk WHERE spk IN (SELECT DISTINCT spk FROM v_utt2spk WHERE length(spk) = 4 AND spk <> 'src3')")
def p21(s, sf):
    t = _corpus(s, sf)
    return d.subset(t, speakers=t["spk2gender"].filter("gender = 'f'"))["utt2spk"]


@query("p22_perturbed_union", "SELECT p || utt AS utt, p || spk AS spk, utt AS uniq FROM v_utt2spk, (SELECT unnest(['', 'sp0.9-', 'sp1.1-']) AS p)")
def p22(s, sf):
    return d.perturbed_union(v.utt2spk(s, sf), ["", "sp0.9-", "sp1.1-"], ["utt", "spk"])


