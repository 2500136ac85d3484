"""Registered queries: tables written in a corpus format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as x, maps as m
from ..operators.helpers import scratch
from ..sources import tables as t
from . import adapters as v
from .adapters import query, table
from .q_language import RU, _rules

c = F.col


@query("a1_read_corpus_table", "SELECT utt, rec, start, \"end\" FROM v_segments")
def a1(s, sf):
    path = scratch(s, "segments")
    t.segment_lines(v.segments(s, sf)).write.text(path)
    return t.read_table(s, path, "segments")[0]


@query("a1_malformed_lines", "SELECT utt || ' ' || rec || ' x' AS value FROM v_segments WHERE length(rec) = 1")
def a1b(s, sf):
    path = scratch(s, "segments")
    good = t.segment_lines(v.segments(s, sf))
    good.unionByName(v.segments(s, sf).filter("length(rec) = 1").select(F.concat_ws(" ", "utt", "rec", F.lit("x")).alias("value"))).write.text(path)
    return t.read_table(s, path, "segments")[1]


@query("a2_read_ctm", "SELECT utt, channel, start, dur, word, CASE WHEN pos % 2 = 0 THEN conf END AS conf FROM v_ctm")
def a2(s, sf):
    path = scratch(s, "ctm")
    t.ctm_lines(v.ctm(s, sf).withColumn("conf", F.when(c("pos") % 2 == 0, c("conf")))).write.text(path)
    return t.read_table(s, path, "ctm")[0]


@query("a5_kwslist_xml", "SELECT kwid, file, channel, tbeg, dur, score, 'YES' AS decision FROM v_hits")
def a5(s, sf):
    path = scratch(s, "kws")
    t.write_kwslist(v.hits(s, sf).select("kwid", "file", "channel", "tbeg", "dur", "score").withColumn("decision", F.lit("YES")), path)
    return t.read_kwslist(s, path)


@query("a3_read_textgrid", "SELECT start, \"end\", utt AS label FROM v_segments")
def a3(s, sf):
    path = scratch(s, "textgrid")
    t.textgrid_files(v.segments(s, sf)).select("value").write.text(path)
    return t.read_textgrid(s, path).select("start", "end", "label")


BIG = "w AS (SELECT word, count(*) AS k FROM v_words GROUP BY word), g AS (SELECT word AS a, lead(word) OVER (PARTITION BY utt ORDER BY pos) AS b FROM v_words), bi AS (SELECT a, b, count(*) AS k FROM g WHERE b IS NOT NULL GROUP BY a, b)"


@query("a4_read_arpa", f"WITH {BIG} SELECT 1 AS n, word AS words, round(-log10(k) - 0.0000001, 6) AS logprob, -0.3::DOUBLE AS backoff FROM w UNION ALL SELECT 2, a || ' ' || b, round(-log10(k) - 0.0000001, 6), NULL FROM bi")
def a4(s, sf):
    grams = [x.ngrams(v.text(s, sf), n).select(F.lit(n).alias("n"), F.split("gram", " ").alias("words"), (-F.log10("n") - 0.0000001).alias("logprob"), F.lit(-0.3 if n == 1 else None).cast("double").alias("backoff")) for n in (1, 2)]
    path = scratch(s, "arpa")
    t.arpa_lines(grams[0].unionByName(grams[1])).orderBy("ord").select("value").write.text(path)
    return t.read_arpa(s, path).withColumn("words", F.array_join("words", " "))


@query("a8_scan_logs", "SELECT 'decode.*.log' AS category, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type = 'error') AS errors, (sum(event_id % 50) FILTER (event_type = 'click'))::BIGINT AS cpu_seconds, count(*) FILTER (event_type = 'click') AS threads FROM events")
def a8(s, sf):
    from ..operators.aggs import log_summary

    e = table(s, sf, "events")
    line = F.when(c("event_type") == "view", "WARNING low").when(c("event_type") == "error", "ERROR high").when(c("event_type") == "click", F.concat(F.lit("# Accounting: time="), c("event_id") % 50, F.lit(" threads=1"))).otherwise("fine")
    path = scratch(s, "logs")
    e.select(line.alias("value")).repartition(4, "event_type").write.text(path)
    folder = s._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(s._jsc.hadoopConfiguration())
    for i, f in enumerate(sorted(str(x.getPath()) for x in files.listStatus(folder) if x.getPath().getName().startswith("part-"))):  # four files
        files.rename(s._jvm.org.apache.hadoop.fs.Path(f), s._jvm.org.apache.hadoop.fs.Path(folder, f"decode.{i + 1}.log"))
    return log_summary(t.scan_logs(s, path))


@query("a11_write_kwslist", "SELECT kwid, 'NO' AS decision, count(*) AS n, min(tbeg) AS first, round(sum(score), 6) AS score FROM v_hits GROUP BY kwid")
def a11(s, sf):
    path = scratch(s, "kws")
    t.write_kwslist(v.hits(s, sf).select("kwid", "file", "channel", "tbeg", "dur", "score").withColumn("decision", F.lit("NO")), path)
    return t.read_kwslist(s, path).groupBy("kwid", "decision").agg(F.count("*").alias("n"), F.min("tbeg").alias("first"), F.round(F.sum("score"), 6).alias("score"))


@query("a9_list_recordings", "SELECT DISTINCT 'src=' || source AS folder FROM documents")
def a9(s, sf):
    path = scratch(s, "wav")
    table(s, sf, "documents").select(c("doc_id").cast("string"), c("source").alias("src")).write.partitionBy("src").text(path)
    return t.list_recordings(s, path, "*.txt").select(F.regexp_extract("path", r"/(src=[^/]+)/[^/]+$", 1).alias("folder")).distinct()


@query("a9_index_paths", "SELECT (doc_id % 7) || '_1' AS disk, '/disks/' || (doc_id % 7) || '-1/wav/' || doc_id || '.wv1' AS path FROM documents WHERE doc_id % 5 > 0")
def a9_paths(s, sf):
    n = c("doc_id")
    line = F.concat((n % 7).cast("string"), F.lit("_1: wav/"), n.cast("string"), F.lit(".wv1"))
    lines = table(s, sf, "documents").select(F.when(n % 5 > 0, line).otherwise(F.concat(F.lit("; "), line)).alias("value"))
    return t.index_paths(lines, [f"/disks/{k}-1/" for k in range(7)])


@query("a13_index_html", "WITH n AS (SELECT rec, string_agg('<p><time type=\"mark\" datetime=\"' || printf('%.2f', start) || '\"></time></p>', chr(10) ORDER BY start) AS html FROM v_segments WHERE length(utt) % 2 = 0 GROUP BY rec) SELECT rec, coalesce(html, '<p>No silences were found.</p>') AS html FROM v_reco2file LEFT JOIN n USING (rec)")
def a13(s, sf):
    return t.index_html(v.segments(s, sf).filter("length(utt) % 2 = 0").select("rec", "start"), v.reco2file(s, sf).select("rec"))


@query("a14_arpa_lines", "WITH n AS (SELECT word, count(*) AS n FROM v_words GROUP BY word HAVING count(*) >= 5) SELECT '\\data\\' AS value UNION ALL SELECT 'ngram 1=' || count(*) FROM n UNION ALL SELECT '\\1-grams:' UNION ALL SELECT printf('%.6f', -log10(n) - 0.0000001) || chr(9) || word || chr(9) || '-0.300000' FROM n UNION ALL SELECT '\\end\\'")
def a14(s, sf):
    w = v.words(s, sf).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 5")
    arpa = w.select(F.lit(1).alias("n"), F.array("word").alias("words"), (-F.log10("n") - 0.0000001).alias("logprob"), F.lit(-0.3).alias("backoff"))
    return t.arpa_lines(arpa).select("value")


@query("b20_syllables_to_phones", "SELECT word, CASE WHEN syl[1] IN ('b', 'd') THEN upper(syl[1]) || ' ' ELSE '' END || 'A' || (length(word) % 5) AS phones FROM (SELECT word, regexp_extract(word, '^[bd]?[aeo]') AS syl FROM v_lexicon) WHERE syl <> ''")
def b20(s, sf):
    """The first syllable of every word that begins with one of these."""
    w = v.lexicon(s, sf).select("word", F.regexp_extract("word", "^[bd]?[aeo]", 0).alias("syl")).filter("syl <> ''").withColumn("syl", F.concat("syl", F.length("word") % 5))
    return m.syllable_phones(w, "syl", {"b": "B", "d": "D"}, {k: ["A"] for k in "aeo"}).select("word", F.array_join("phones", " ").alias("phones"))


@query("e26_abbreviation_score", "SELECT count(*) FILTER (length(w) % 3 = 0) AS tp, count(*) FILTER (length(w) % 3 <> 0) AS fp FROM (SELECT DISTINCT words[1] AS w FROM v_text)")
def e26(s, sf):
    found = v.text(s, sf).select(F.upper(c("words")[0]).alias("long")).distinct()
    return x.abbreviation_score(found, found.filter("length(long) % 3 = 0").select(F.lower("long").alias("long")))


HI = "hi AS (SELECT a.suffix || ',' || a.base_suffix || ',' || a.psuffix || ',' || a.base_psuffix AS specific, b.suffix || ',' || b.base_suffix || ',' || b.psuffix || ',' || b.base_psuffix AS general FROM ru a, range(1, 3) r(i), ru b WHERE i <= least(length(a.suffix), length(a.base_suffix)) AND a.suffix[1:i] = a.base_suffix[1:i] AND b.suffix = a.suffix[i + 1:] AND b.base_suffix = a.base_suffix[i + 1:] AND a.psuffix = b.psuffix AND a.base_psuffix = b.base_psuffix)"


@query("l13_rule_hierarchy", f"WITH {RU}, {HI} SELECT * FROM hi")
def l13(s, sf):
    return x.rule_hierarchy(_rules(s, sf))


@query("l15_limit_to_specific", "SELECT word, 'b' AS base_word, 'no' AS destress, CASE WHEN length(word) % 2 = 0 THEN 'S' ELSE 'G' END AS rule FROM v_lexicon UNION ALL SELECT word, 'c', 'no', 'G' FROM v_lexicon")
def l15(s, sf):
    w = v.lexicon(s, sf).select("word")
    cand = lambda base, rule: [F.lit(base).alias("base_word"), F.lit("no").alias("destress"), F.lit(rule).alias("rule")]
    cands = w.select("word", *cand("b", "G")).unionByName(w.filter("length(word) % 2 = 0").select("word", *cand("b", "S"))).unionByName(w.select("word", *cand("c", "G")))
    return x.limit_to_specific(cands, s.createDataFrame([("S", "G")], "specific string, general string"))


@query("x14_strip_stress", "SELECT word, word[1] || ' ' || word[2] AS bare FROM v_lexicon")
def x14(s, sf):
    p = F.array(F.concat(F.substring("word", 1, 1), F.lit("1")), F.concat(F.substring("word", 2, 1), F.lit("0")))
    return v.lexicon(s, sf).select("word", F.array_join(F.transform(p, lambda q: F.regexp_replace(q, r"\d$", "")), " ").alias("bare"))


@query("x15_accounting", "SELECT event_id, event_id % 50 AS time, user_id % 8 AS threads FROM events")
def x15(s, sf):
    line = F.concat(F.lit("# Accounting: time="), c("event_id") % 50, F.lit(" threads="), c("user_id") % 8)
    e = table(s, sf, "events").select("event_id", line.alias("l"))
    return e.select("event_id", F.regexp_extract("l", r"time=(\d+)", 1).cast("long").alias("time"), F.regexp_extract("l", r"threads=(\d+)", 1).cast("long").alias("threads"))
