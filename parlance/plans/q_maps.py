"""Registered queries: filters, key maps and row-wise transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maps as m
from . import adapters as v
from .adapters import query, table

c = F.col


@query("b1_filter_by_ids", "SELECT utt, spk FROM v_utt2spk WHERE utt IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)")
def b1(s, sf):
    return m.filter_by_ids(v.utt2spk(s, sf), table(s, sf, "labels").filter("quality = 1").select(c("doc_id").cast("string").alias("id")), "utt")


@query("b1_exclude_ids", "SELECT utt, spk FROM v_utt2spk WHERE utt NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)")
def b1x(s, sf):
    return m.filter_by_ids(v.utt2spk(s, sf), table(s, sf, "labels").filter("quality = 1").select(c("doc_id").cast("string").alias("id")), "utt", exclude=True)


@query("b2_filter_by_many_ids", "SELECT DISTINCT utt, spk, j AS job FROM v_utt2spk JOIN (SELECT doc_id::VARCHAR AS id, 'q' || quality AS j FROM labels UNION ALL SELECT doc_id::VARCHAR, 't' || toxic FROM labels) ON id = utt")
def b2(s, sf):
    lab = table(s, sf, "labels")
    ids = lab.select(c("doc_id").cast("string").alias("utt"), F.concat(F.lit("q"), "quality").alias("job")).unionByName(lab.select(c("doc_id").cast("string").alias("utt"), F.concat(F.lit("t"), "toxic").alias("job")))
    return m.filter_by_many_ids(v.utt2spk(s, sf), ids, "utt")


@query("b3_apply_map", "SELECT utt, string_agg(CASE WHEN length(word) BETWEEN 2 AND 4 THEN word || '_a ' || word || '_b' ELSE word END, ' ' ORDER BY pos) AS mapped FROM v_words GROUP BY utt")
def b3(s, sf):
    syms = v.words(s, sf).select(c("word").alias("sym")).distinct().filter("length(sym) between 2 and 4")
    mapping = syms.withColumn("values", F.array(F.concat("sym", F.lit("_a")), F.concat("sym", F.lit("_b"))))
    return m.map_tokens(v.text(s, sf), mapping, "utt", "words", permissive=True).select("utt", F.array_join("words", " ").alias("mapped"))


@query("b4_sym2int", "SELECT utt, string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids, count(*) FILTER (id IS NULL) AS n_oov FROM v_words LEFT JOIN v_symtab ON sym = word GROUP BY utt")
def b4(s, sf):
    return m.symbols_to_ids(v.text(s, sf), v.symtab(s, sf), "utt", "words", oov=1).select("utt", F.array_join(c("ids").cast("array<string>"), " ").alias("ids"), "n_oov")


@query("b4_replacements", """SELECT count(DISTINCT utt) AS n_rows, count(*) AS n_tokens, count(*) FILTER (length(word) > 9) AS n_oov, count(DISTINCT utt) FILTER (length(word) > 9) AS n_rows_oov FROM v_words""")
def b4_observed(s, sf):
    """Words of up to nine letters have ids; what the others were replaced in is observed while the ids are written."""
    from ..operators.helpers import scratch

    table = v.symtab(s, sf).filter("length(sym) <= 9")
    return s.createDataFrame([m.write_ids(v.text(s, sf), table, "utt", "words", scratch(s, "ids"), 1)], "n_rows long, n_tokens long, n_oov long, n_rows_oov long")


@query("b5_int2sym", "SELECT utt, string_agg(word, ' ' ORDER BY pos) AS words FROM v_words JOIN v_symtab ON sym = word GROUP BY utt")
def b5(s, sf):
    table = v.symtab(s, sf)
    ids = m.symbols_to_ids(v.text(s, sf), table, "utt", "words")
    return m.ids_to_symbols(ids, table, "utt", "ids").select("utt", F.array_join("words", " ").alias("words"))


@query("b6_utt2spk_to_spk2utt", "SELECT spk, string_agg(utt, ' ' ORDER BY utt::BIGINT) AS utts, min(utt::BIGINT) AS first FROM v_utt2spk GROUP BY spk")
def b6(s, sf):
    u = v.utt2spk(s, sf).withColumn("n", c("utt").cast("long"))
    return m.group_utterances(u, "n").select("spk", F.array_join("utts", " ").alias("utts"), "first")


@query("b7_spk2utt_to_utt2spk", "SELECT utt, spk FROM v_utt2spk")
def b7(s, sf):
    return m.flatten_utterances(m.group_utterances(v.utt2spk(s, sf).withColumn("n", c("utt").cast("long")), "n"))


@query("b8_subset_first", "SELECT utt, spk FROM v_utt2spk ORDER BY utt LIMIT 100")
def b8a(s, sf):
    return m.subset(v.utt2spk(s, sf), 100, "utt")


@query("b8_subset_last", "SELECT utt, spk FROM v_utt2spk ORDER BY utt DESC LIMIT 100")
def b8b(s, sf):
    return m.subset(v.utt2spk(s, sf), 100, "utt", "last")


@query("b8_subset_spread", """WITH RECURSIVE h AS (SELECT 0::BIGINT AS lo, count(*) AS size, least(100, count(*)) AS quota FROM v_utt2spk
  UNION ALL SELECT CASE WHEN k = 0 THEN lo ELSE lo + size // 2 END, CASE WHEN k = 0 THEN size // 2 ELSE size - size // 2 END, CASE WHEN k = 0 THEN quota // 2 ELSE quota - quota // 2 END FROM h, (SELECT unnest([0, 1]) AS k) WHERE size > 1 AND quota > 0 AND quota <> size),
 n AS (SELECT utt, spk, row_number() OVER (ORDER BY utt) - 1 AS i FROM v_utt2spk) SELECT utt, spk FROM n JOIN h ON i >= lo AND i < lo + size WHERE quota > 0 AND (size <= 1 OR quota = size)""")
def b8c(s, sf):
    return m.subset(v.utt2spk(s, sf), 100, "utt", "spread")


@query("b9_shuffle", "SELECT utt, spk FROM v_utt2spk ORDER BY md5('777|' || utt), utt")
def b9(s, sf):
    return m.shuffle(v.utt2spk(s, sf), "utt")


@query("b10_oov_replace", "SELECT utt, string_agg(CASE WHEN sym IS NULL THEN '<UNK>' ELSE word END, ' ' ORDER BY pos) AS words FROM v_words LEFT JOIN v_symtab ON sym = word GROUP BY utt")
def b10(s, sf):
    from ..operators.helpers import ordered_list

    return m.replace_unknown(v.words(s, sf), v.lexicon(s, sf)).groupBy("utt").agg(F.array_join(ordered_list(["pos"], "word"), " ").alias("words"))


@query("b11_drop_edges", "SELECT c_custkey AS a, c_mktsegment AS b, n_name AS x, r_name AS y FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT IN ('FRANCE', 'ASIA') AND r_name NOT IN ('FRANCE', 'ASIA')")
def b11(s, sf):
    e = table(s, sf, "customer").join(table(s, sf, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(s, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    e = e.select(c("c_custkey").alias("a"), c("c_mktsegment").alias("b"), c("n_name").alias("x"), c("r_name").alias("y"))
    return m.drop_edges(e, s.createDataFrame([("FRANCE",), ("ASIA",)], "sym string"), ("x", "y"))


@query("b12_derive_speaker", "SELECT utt, string_split(spk || '_' || utt, '_')[1] AS a, substr(spk || utt, 1, 3) AS b FROM v_utt2spk")
def b12(s, sf):
    u = v.utt2spk(s, sf).select("utt", F.concat_ws("_", "spk", "utt").alias("x"), F.concat("spk", "utt").alias("y"))
    return u.select("utt", m.derive_speaker("x").alias("a"), m.derive_speaker("y", "three").alias("b"))


@query("b13_rename_ids", "SELECT 'p-' || utt || '-s' AS utt, 'p-' || spk || '-s' AS spk FROM v_utt2spk")
def b13(s, sf):
    return m.rename_ids(v.utt2spk(s, sf), ["utt", "spk"], "p-", "-s")


RAW = "SELECT utt, string_agg(CASE pos % 9 WHEN 0 THEN '[' || word || ']' WHEN 1 THEN '[<' || word || ']' WHEN 2 THEN '<' || word || '>' WHEN 3 THEN '%percent' WHEN 4 THEN '.point' WHEN 5 THEN '--dash' ELSE word END, ' ' ORDER BY pos) AS t FROM v_words GROUP BY utt"


def _marked(s, sf):
    from ..operators.helpers import ordered_list

    w, k = c("word"), c("pos") % 9
    x = F.when(k == 0, F.concat(F.lit("["), w, F.lit("]"))).when(k == 1, F.concat(F.lit("[<"), w, F.lit("]"))).when(k == 2, F.concat(F.lit("<"), w, F.lit(">"))).when(k == 3, "%percent").when(k == 4, ".point").when(k == 5, "--dash").otherwise(w)
    return v.words(s, sf).withColumn("x", x).groupBy("utt").agg(ordered_list(["pos"], "x").alias("words"))


@query("b14_normalize_transcript", "SELECT utt, string_agg(CASE pos % 9 WHEN 0 THEN '<NOISE>' WHEN 2 THEN upper(word) WHEN 3 THEN 'PERCENT' WHEN 4 THEN 'POINT' WHEN 5 THEN '-DASH' ELSE upper(word) END, ' ' ORDER BY pos) FILTER (pos % 9 <> 1) AS words FROM v_words GROUP BY utt")
def b14(s, sf):
    out = _marked(s, sf).select("utt", m.normalize_words(c("words")).alias("w"))
    return out.select("utt", F.when(F.size("w") > 0, F.array_join("w", " ")).alias("words"))


@query("b15_scoring_filter", "SELECT utt, regexp_replace(regexp_replace(array_to_string(words, ' '), '\\bth\\w*\\b ?', '', 'g'), 'on', 'ON', 'g') AS words FROM v_text")
def b15(s, sf):
    return v.text(s, sf).select("utt", m.substitute(F.array_join("words", " "), [(r"\bth\w*\b ?", ""), ("on", "ON")]).alias("words"))


@query("b16_lexicon_filter", "SELECT word, array_to_string(phones, ' ') AS phones FROM v_lexicon WHERE NOT regexp_matches(word, '[;,]')")
def b16(s, sf):
    return m.plain_lexicon(v.lexicon(s, sf)).select("word", F.array_join("phones", " ").alias("phones"))


@query("b17_reverse_lexicon", "SELECT reverse(word) AS word, array_to_string(list_reverse(phones), ' ') AS phones FROM v_lexicon")
def b17(s, sf):
    return m.reverse_lexicon(v.lexicon(s, sf)).select("word", F.array_join("phones", " ").alias("phones"))


@query("b18_load_dictionary", "SELECT word, array_to_string(phones, ' ') AS phones FROM v_lexicon UNION SELECT '!SIL', 'SIL'")
def b18(s, sf):
    lx = v.lexicon(s, sf)
    lines = lx.select(F.concat("word", F.lit("(2)  "), F.array_join("phones", " ")).alias("line")).unionByName(lx.select(F.concat("word", F.lit(" "), F.array_join("phones", " ")).alias("line"))).unionByName(lx.select(F.concat(F.lit(";;; "), "word").alias("line")))
    lines = lines.select(F.regexp_replace("line", "  ", " ").alias("line"))
    return m.load_dictionary(lines, ["!SIL SIL"]).select("word", F.array_join("phones", " ").alias("phones"))


@query("b19_sentence_split", """WITH t AS (SELECT utt, pos, word, pos % 10 = 0 AND length(word) % 2 = 0 AS e FROM v_words),
 l AS (SELECT utt, pos, word, coalesce(sum(e::INT) OVER (PARTITION BY utt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line FROM t)
 SELECT utt, line, string_agg(CASE WHEN pos % 10 = 0 AND length(word) % 2 = 1 THEN word || '.' ELSE word END, ' ' ORDER BY pos) AS text FROM l GROUP BY utt, line""")
def b19(s, sf):
    w = v.words(s, sf).withColumn("word", F.when(c("pos") % 10 == 0, F.concat("word", F.lit("."))).otherwise(c("word")))
    vocab = w.filter("word like '%.' and length(word) % 2 = 0").select("word").distinct()
    return m.split_sentences(w, vocab)


@query("b21_job_status_filter", "SELECT jobid, username FROM v_jobs WHERE status = 'E' AND username = '7'")
def b21(s, sf):
    return m.job_status(v.jobs(s, sf), "E", "7").select("jobid", "username")
