"""Registered queries: aggregations and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs as a
from ..operators.helpers import seeded
from . import adapters as v
from .adapters import query, table

c = F.col
r6 = lambda x: F.round(x, 6)


@query("e1_word_counts", "SELECT word, count(*) AS n FROM v_words GROUP BY word")
def e1(s, sf):
    return a.word_counts(v.words(s, sf))


@query("e2_top_words", "SELECT word, n, round(n / (SELECT count(*) FROM v_words), 6) AS share FROM (SELECT word, count(*) AS n FROM v_words GROUP BY word) ORDER BY n DESC, word LIMIT 100")
def e2(s, sf):
    return a.top_words(v.words(s, sf)).withColumn("share", r6("share"))


def _vocab(s, sf):
    return v.words(s, sf).select("word").distinct().filter("length(word) <= 4")


@query("e3_oov_counts", "SELECT word, count(*) AS n FROM v_words WHERE length(word) > 4 GROUP BY word HAVING count(*) >= 3")
def e3(s, sf):
    return a.oov_counts(v.words(s, sf), _vocab(s, sf), 3)


@query("e4_oov_mass", "SELECT sum(n)::BIGINT AS mass FROM (SELECT count(*) AS n FROM v_words WHERE length(word) > 4 GROUP BY word HAVING count(*) < 3)")
def e4(s, sf):
    return a.oov_mass(v.words(s, sf), _vocab(s, sf), 3)


CSID = "SELECT utt, count(*) FILTER (op = 'C') AS c, count(*) FILTER (op = 'S') AS s, count(*) FILTER (op = 'I') AS i, count(*) FILTER (op = 'D') AS d FROM (SELECT utt, CASE WHEN hyp = '<eps>' THEN 'D' WHEN ref = '<eps>' THEN 'I' WHEN ref <> hyp THEN 'S' ELSE 'C' END AS op FROM v_pairs) GROUP BY utt"


@query("q3_classify_pairs", CSID)
def q3(s, sf):
    return a.edit_counts(v.pairs(s, sf))


@query("e5_wer_by_speaker", f"""WITH k AS ({CSID}), g AS (SELECT CASE WHEN grouping(spk) = 1 THEN 'SUM' ELSE spk END AS spk, count(*) AS n_sent, sum(c)::BIGINT AS c, sum(s)::BIGINT AS s, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d, (count(*) FILTER (s + i + d > 0))::BIGINT AS sent_err FROM k JOIN v_utt2spk USING (utt) GROUP BY ROLLUP (spk))
 SELECT spk, n_sent, c + s + d AS n_word, c, s, i, d, s + i + d AS err, sent_err, round(100.0 * c / (c + s + d), 2) AS c_pct, round(100.0 * s / (c + s + d), 2) AS s_pct, round(100.0 * i / (c + s + d), 2) AS i_pct, round(100.0 * d / (c + s + d), 2) AS d_pct, round(100.0 * (s + i + d) / (c + s + d), 2) AS err_pct, round(100.0 * sent_err / n_sent, 2) AS sent_err_pct FROM g""")
def e5(s, sf):
    return a.wer_by_speaker(a.edit_counts(v.pairs(s, sf)), v.utt2spk(s, sf))


@query("e6_edit_op_table", "SELECT ref, hyp, count(*) AS n, CASE WHEN hyp = '<eps>' THEN 'deletion' WHEN ref = '<eps>' THEN 'insertion' WHEN ref <> hyp THEN 'substitution' ELSE 'correct' END AS op FROM v_pairs GROUP BY ref, hyp")
def e6(s, sf):
    return a.edit_op_table(v.pairs(s, sf))


@query("e7_wer_summary", f"WITH k AS ({CSID}), t AS (SELECT sum(s + i + d)::BIGINT AS e, sum(c + s + d)::BIGINT AS w, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d, sum(s)::BIGINT AS s FROM k) SELECT '%WER ' || printf('%.2f', 100.0 * e / w) || ' [ ' || e || ' / ' || w || ', ' || i || ' ins, ' || d || ' del, ' || s || ' sub ]' AS line FROM t")
def e7(s, sf):
    k = a.edit_counts(v.pairs(s, sf)).agg(*[F.sum(x).alias(x) for x in "csid"])
    return k.select(a.wer_line(c("s") + c("i") + c("d"), c("c") + c("s") + c("d"), c("i"), c("d"), c("s")).alias("line"))


@query("e8_best_wer", "WITH g AS (SELECT rec, label, round(avg(end_cs - start_cs), 3) AS wer FROM v_labelseg GROUP BY rec, label) SELECT rec, label, wer FROM g ORDER BY wer, rec, label LIMIT 1")
def e8(s, sf):
    g = v.labelseg(s, sf).groupBy("rec", "label").agg(F.round(F.avg(c("end_cs") - c("start_cs")), 3).alias("wer"))
    return a.best(g, "wer", ["rec", "label"])


def _observed(s, sf):
    w = v.words(s, sf)
    return w.select("utt", "pos", "word", F.concat(F.lit("p"), (c("pos") % 3).cast("string")).alias("pron"))


OBS = "obs AS (SELECT utt, pos, word, 'p' || (pos % 3) AS pron FROM v_words), lex AS (SELECT DISTINCT word, unnest(['p0', 'p1', 'p2', 'p3']) AS pron FROM obs)"


def _lex(s, sf):
    return _observed(s, sf).select("word").distinct().select("word", F.explode(F.array(*[F.lit(f"p{i}") for i in range(4)])).alias("pron"))


@query("e9_lexicon_probs", f"WITH {OBS}, n AS (SELECT word, pron, 1.0 + coalesce(k, 0) AS n FROM lex LEFT JOIN (SELECT word, pron, count(*) AS k FROM obs GROUP BY ALL) USING (word, pron)) SELECT word, pron, round((n / max(n) OVER (PARTITION BY word))::DOUBLE, 6) AS prob FROM n")
def e9(s, sf):
    return a.lexicon_probs(_observed(s, sf), _lex(s, sf)).withColumn("prob", r6("prob"))


@query("e10_pron_probs", f"WITH {OBS}, n AS (SELECT word, pron, 1 + coalesce(k, 0) AS n FROM lex LEFT JOIN (SELECT word, pron, count(*) AS k FROM obs GROUP BY ALL) USING (word, pron)) SELECT word, pron, round(n / sum(n) OVER (PARTITION BY word), 6) AS prob FROM n")
def e10(s, sf):
    n = _observed(s, sf).groupBy("word", "pron").agg(F.count("*").alias("n"))
    return a.pron_probs(_lex(s, sf), n).withColumn("prob", r6("prob"))


def _prons(s, sf):
    w = v.words(s, sf)
    return w.select("utt", "pos", F.when(c("pos") % 6 == 0, "<eps>").otherwise(F.substring("word", 1, 2)).alias("word"), F.lit("").alias("pron"))


PR = """pr AS (SELECT utt, pos, CASE WHEN pos % 6 = 0 THEN '<eps>' ELSE substr(word, 1, 2) END AS word FROM v_words),
 al AS (SELECT * FROM pr UNION ALL SELECT utt, min(pos) - 1, '<s>' FROM pr GROUP BY utt UNION ALL SELECT utt, max(pos) + 1, '</s>' FROM pr GROUP BY utt),
 nb AS (SELECT utt, pos, word, lag(word) OVER w AS b, lead(word) OVER w AS a FROM al WINDOW w AS (PARTITION BY utt ORDER BY pos)),
 ct AS (SELECT word, '' AS pron, count(*) FILTER (b = '<eps>') AS sil_before, count(*) FILTER (b <> '<eps>') AS nonsil_before, count(*) FILTER (a = '<eps>') AS sil_after, count(*) FILTER (a <> '<eps>') AS nonsil_after FROM nb WHERE word <> '<eps>' GROUP BY word)"""


@query("e12_silence_neighbours", f"WITH {PR} SELECT * FROM ct")
def e12(s, sf):
    return a.silence_neighbours(_prons(s, sf))


SP = f"""{PR}, tt AS (SELECT sum(sil_after) / sum(sil_after + nonsil_after) AS p FROM ct WHERE word NOT IN ('<s>', '</s>')),
 sp AS (SELECT word, pron, least(0.99, greatest(0.01, floor((sil_before + p * 2) / (sil_before + nonsil_before + 2) * 100 + 0.5) / 100)) AS p_before, least(0.99, greatest(0.01, floor((sil_after + p * 2) / (sil_after + nonsil_after + 2) * 100 + 0.5) / 100)) AS p_after FROM ct, tt)"""


@query("e11_silence_probs", f"WITH {SP} SELECT * FROM sp")
def e11(s, sf):
    return a.silence_probs(a.silence_neighbours(_prons(s, sf)))


BG = "ns AS (SELECT utt, pos, word FROM al WHERE word <> '<eps>'), bg AS (SELECT v, w, count(*) AS n FROM (SELECT word AS v, lead(word) OVER (PARTITION BY utt ORDER BY pos) AS w FROM ns) WHERE w IS NOT NULL GROUP BY v, w)"


def _bigrams(s, sf):
    from ..operators.lexical import pron_bigrams

    return pron_bigrams(_prons(s, sf).select("utt", "pos", "word"))


@query("e27_silence_correction", f"WITH {SP}, {BG}, ex AS (SELECT w, sum(n * p_after) AS cs, sum(n * (1 - p_after)) AS cn FROM bg JOIN sp ON v = word GROUP BY w) SELECT word, greatest(0.01, floor((sil_before + 2) / (round(cs, 6) + 2) * 100 + 0.5) / 100) AS f_sil, greatest(0.01, floor((nonsil_before + 2) / (round(cn, 6) + 2) * 100 + 0.5) / 100) AS f_nonsil FROM ct JOIN ex ON word = w")
def e27(s, sf):
    n = a.silence_neighbours(_prons(s, sf))
    return a.silence_correction(a.silence_probs(n), n, _bigrams(s, sf))


@query("l20_pron_bigrams", f"WITH {PR}, {BG} SELECT v, w, n FROM bg")
def l20(s, sf):
    return _bigrams(s, sf)


@query("e13_pron_counts", "SELECT word, CASE WHEN length(word) = 2 THEN word[1] || ' ' || word[2] ELSE word END AS pron, count(*) AS n FROM v_words GROUP BY ALL")
def e13(s, sf):
    w = v.words(s, sf)
    p = F.when(F.length("word") == 2, F.concat(F.substring("word", 1, 1), F.lit("_B "), F.substring("word", 2, 1), F.lit("_E"))).otherwise(F.concat("word", F.lit("_S")))
    return a.pron_counts(w.select("word", p.alias("pron")))


@query("e14_pron_report", f"WITH {OBS}, n AS (SELECT word, pron, count(*) AS n FROM obs GROUP BY ALL) SELECT word, pron, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, pron) AS rank, round(n / sum(n) OVER (PARTITION BY word), 6) AS share, CASE WHEN pron = 'p2' THEN 'INCORRECT' ELSE 'CORRECT' END AS verdict, 'p0 | p1 | p3' AS reference FROM n")
def e14(s, sf):
    return a.pron_report(_observed(s, sf), _lex(s, sf).filter("pron <> 'p2'")).withColumn("share", r6("share"))


@query("n7_suspicious_prons", f"WITH {OBS}, n AS (SELECT word, pron, count(*) AS n FROM obs GROUP BY ALL), r AS (SELECT word, pron, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, pron) AS rank, n / sum(n) OVER (PARTITION BY word) AS share FROM n) SELECT word, pron, n FROM r WHERE pron = 'p2' AND rank = 1 AND share > 0.4 AND n > 10 ORDER BY n DESC, word LIMIT 20")
def n7(s, sf):
    r = a.pron_report(_observed(s, sf), _lex(s, sf).filter("pron <> 'p2'"))
    return r.filter("verdict = 'INCORRECT' and rank = 1 and share > 0.4 and n > 10").orderBy(F.desc("n"), "word").limit(20).select("word", "pron", "n")


@query("n6_lowest_prob_prons", f"WITH {OBS}, n AS (SELECT word, pron, 1 + coalesce(k, 0) AS n FROM lex LEFT JOIN (SELECT word, pron, count(*) AS k FROM obs GROUP BY ALL) USING (word, pron)) SELECT word, pron, round(n / sum(n) OVER (PARTITION BY word), 6) AS prob FROM n ORDER BY prob, word, pron LIMIT 8")
def n6(s, sf):
    return e10(s, sf).orderBy("prob", "word", "pron").limit(8)


def _graded(s, sf):
    e = table(s, sf, "events")
    return e.select(c("event_type").alias("rule"), F.when(c("user_id") % 2 == 0, "yes").otherwise("no").alias("destress"), F.when(c("event_id") % 3 == 0, "right").when(c("event_id") % 3 == 1, "partial").otherwise("wrong").alias("grade"))


RC = "rc AS (SELECT event_type AS rule, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS destress, count(*) FILTER (event_id % 3 = 0) AS \"right\", count(*) FILTER (event_id % 3 = 1) AS \"partial\", count(*) FILTER (event_id % 3 = 2) AS wrong FROM events GROUP BY ALL)"


@query("e15_rule_counts", f"WITH {RC} SELECT * FROM rc")
def e15(s, sf):
    return a.rule_counts(_graded(s, sf))


@query("e16_rule_scores", f"WITH {RC} SELECT rule, destress, round((\"right\" + 0.8 * \"partial\") / (\"right\" + \"partial\" + wrong + 1) - CASE WHEN destress = 'yes' THEN 1e-5 ELSE 0 END, 5) AS score FROM rc")
def e16(s, sf):
    return a.rule_scores(a.rule_counts(_graded(s, sf)))


TH = "th AS (SELECT kwid, sum(score) AS t, sum(score) / (3600.0 / 999.9 + 998.9 / 999.9 * sum(score)) AS threshold FROM v_hits GROUP BY kwid)"


@query("e17_keyword_thresholds", f"WITH {TH} SELECT kwid, round(t, 6) AS n_true, round(threshold, 6) AS threshold FROM th")
def e17(s, sf):
    return a.keyword_thresholds(v.hits(s, sf)).select("kwid", r6("n_true").alias("n_true"), r6("threshold").alias("threshold"))


@query("e18_speaker_stats", "SELECT spk, dim, count(*) AS n, round(sum(x), 4) AS s, round(sum(x * x), 4) AS s2 FROM (SELECT spk, unnest(range(0, len(vec))) AS dim, unnest(vec) AS x FROM v_feats) GROUP BY spk, dim")
def e18(s, sf):
    return a.speaker_stats(v.feats(s, sf)).withColumn("s", F.round("s", 4)).withColumn("s2", F.round("s2", 4))


@query("e19_class_priors", "SELECT dim, round(sum(abs(x)) / (SELECT sum(abs(y)) FROM (SELECT unnest(vec) AS y FROM v_feats)), 6) AS prior FROM (SELECT unnest(range(0, len(vec))) AS dim, unnest(vec) AS x FROM v_feats) GROUP BY dim")
def e19(s, sf):
    t = v.feats(s, sf).select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.sum(F.abs("x")).alias("t"))
    return t.join(F.broadcast(t.agg(F.sum("t").alias("all")))).select("dim", r6(c("t") / c("all")).alias("prior"))


@query("e20_total_speech", "SELECT round(sum(\"end\" - start), 2) AS seconds, round(sum(\"end\" - start) / 3600, 6) AS hours, floor(round(sum(\"end\" - start) * 100, 3))::BIGINT AS frames FROM v_segments")
def e20(s, sf):
    return a.total_speech(v.segments(s, sf))


@query("e21_estimate_frames", "WITH p AS (SELECT utt, len(words) AS n FROM v_text ORDER BY md5('777|' || utt), utt LIMIT 200) SELECT (sum(n) * (SELECT count(*) FROM v_text) // 200)::BIGINT AS frames FROM p")
def e21(s, sf):
    t = v.text(s, sf).select("utt", F.size("words").alias("n"))
    p = t.orderBy(seeded("utt"), "utt").limit(200).agg(F.sum("n").alias("s"))
    return p.join(F.broadcast(t.agg(F.count("*").alias("files")))).select(F.floor(c("s") * c("files") / 200).alias("frames"))


@query("e23_log_summary", "SELECT 'decode.*.' || (user_id % 3) || '.log' AS category, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type = 'error') AS errors, (sum(event_id % 50 * 4) FILTER (event_type = 'click'))::BIGINT AS cpu_seconds, (4 * count(*) FILTER (event_type = 'click'))::BIGINT AS threads FROM events GROUP BY user_id % 3")
def e23(s, sf):
    e = table(s, sf, "events")
    line = F.when(c("event_type") == "view", "WARNING low").when(c("event_type") == "error", "ERROR high").when(c("event_type") == "click", F.concat(F.lit("# Accounting: time="), c("event_id") % 50, F.lit(" threads=4"))).otherwise("fine")
    return a.log_summary(e.select(F.concat(F.lit("decode."), "event_id", F.lit("."), c("user_id") % 3, F.lit(".log")).alias("file"), line.alias("line")))


@query("e24_word_delta", "SELECT count(*) AS before, count(*) FILTER (pos % 13 > 0) AS after FROM v_words")
def e24(s, sf):
    return v.words(s, sf).agg(F.count("*").alias("before"), F.count_if(c("pos") % 13 > 0).alias("after"))


@query("e25_jobs_by_status", "SELECT username, status, count(*) AS n FROM v_jobs GROUP BY CUBE (username, status)")
def e25(s, sf):
    return v.jobs(s, sf).cube("username", "status").agg(F.count("*").alias("n"))


@query("e28_utterance_mass", "SELECT utt, round(list_sum(vec), 4) AS mass FROM v_feats")
def e28(s, sf):
    return v.feats(s, sf).select("utt", F.round(F.aggregate("vec", F.lit(0.0), lambda x, y: x + y), 4).alias("mass"))


@query("n1_sort_unique", "SELECT kwid, file, tbeg FROM (SELECT *, row_number() OVER (PARTITION BY kwid, file ORDER BY tbeg) AS k FROM v_hits) WHERE k = 1")
def n1(s, sf):
    return v.hits(s, sf).groupBy("kwid", "file").agg(F.min("tbeg").alias("tbeg"))


@query("n2_rank_hits", "SELECT kwid, file, score, tbeg, pos, utt, row_number() OVER (ORDER BY regexp_extract(kwid, '(\\d+)$', 1)::INT, score DESC, file, tbeg, utt, pos) AS rank FROM v_hits")
def n2(s, sf):
    from ..operators.helpers import numbered

    k = F.regexp_extract("kwid", r"(\d+)$", 1).cast("int")
    return numbered(v.hits(s, sf).select("kwid", "file", "score", "tbeg", "pos", "utt"), [k, F.desc("score"), "file", "tbeg", "utt", "pos"], "rank")


@query("n3_top_n_prons", "WITH b AS (SELECT utt AS word, model AS pron, max(s) AS s FROM (SELECT rec AS utt, model, 1 + score / 10 AS s FROM v_scores) GROUP BY ALL) SELECT word, pron, round(s, 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, pron) AS k FROM b WHERE s >= 0.35) WHERE k <= 4")
def n3(s, sf):
    from ..operators.topk import top_per_group

    b = v.scores(s, sf).groupBy(c("rec").alias("word"), c("model").alias("pron")).agg(F.max(1 + c("score") / 10).alias("s"))
    return top_per_group(b.filter("s >= 0.35"), ["word"], [F.desc("s"), "pron"], 4).withColumn("s", r6("s"))


@query("n4_shortest_utterances", "SELECT utt, len(words) AS n FROM v_text ORDER BY n, utt LIMIT 50")
def n4(s, sf):
    return v.text(s, sf).select("utt", F.size("words").alias("n")).orderBy("n", "utt").limit(50)


@query("n5_worst_utterances", f"WITH k AS ({CSID}) SELECT utt, s + i + d AS err, c + s + d AS n FROM k ORDER BY err DESC, utt LIMIT 30")
def n5(s, sf):
    k = a.edit_counts(v.pairs(s, sf))
    return k.select("utt", (c("s") + c("i") + c("d")).alias("err"), (c("c") + c("s") + c("d")).alias("n")).orderBy(F.desc("err"), "utt").limit(30)


@query("n8_nbest_limit", "SELECT event_id, model, score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, model) AS k FROM v_scores) WHERE k <= 3")
def n8(s, sf):
    from ..operators.topk import top_per_group

    return top_per_group(v.scores(s, sf), ["event_id"], [F.desc("score"), "model"], 3).select("event_id", "model", "score")
