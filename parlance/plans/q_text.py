"""Registered queries: text, numbers, HTML, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.helpers import ordered_list
from . import adapters as v
from .adapters import query, table

c = F.col


@query("x1_standardise_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g')) AS text FROM documents")
def x1(s, sf):
    return table(s, sf, "documents").select("doc_id", x.standardise(c("text")).alias("text"))


#: Block tags become a space and other tags nothing; then references, controls and white space. Pages here hold no time elements.
PLAIN = r"""regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '</?\s*(?:br|p|div|li|h1)(?:[^\w>][^>]*)?>', ' ', 'gi'), '<[^>]*>', '', 'g'),
 '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}]', '', 'g'), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', ' ', 'g')"""


@query("x2_html_to_text", f"SELECT page_id AS id, {PLAIN} AS text FROM pages")
def x2(s, sf):
    return x.html_to_text(table(s, sf, "pages"), "page_id", "html")


@query("x3_html_to_text_map")
def x3(s, sf):
    return x.html_to_text(table(s, sf, "pages"), "page_id", "html", True).select("id", "text", F.size("places").alias("n"), F.array_max("places.page").alias("last"))


@query("x4_strip_timing_tags", "SELECT page_id, regexp_replace(html, '<p>', '', 'g') AS html FROM pages")
def x4(s, sf):
    h = F.regexp_replace("html", "<p>", '<time type="mark" datetime="1.0"></time><conf c="1"></conf>')
    return table(s, sf, "pages").select("page_id", x.strip_timing(h).alias("html"))


@query("x5_insert_timing_tags", "SELECT page_id AS id, html[1:10] || '<conf>' || html[11:20] || '<time>' || html[21:] AS html FROM pages")
def x5(s, sf):
    p = table(s, sf, "pages").select(c("page_id").alias("id"), "html")
    t = p.select("id", F.lit(20).alias("at"), F.lit("<time>").alias("tag")).unionByName(p.select("id", F.lit(10).alias("at"), F.lit("<conf>").alias("tag")))
    return x.insert_tags(p, t).select("id", "html")


def _numbers(s, sf):
    return table(s, sf, "orders").select(c("o_orderkey").cast("string").alias("utt"), F.lit(1).alias("pos"), (c("o_orderkey") * 37).cast("string").alias("word"))


def _spoken(ones: str, tens: str, below_100: str, hundred: str, after_hundred: str, units: tuple[str, str], link: str, zero: str) -> str:
    """SQL that says the numbers: words below 100, then below 1000, then the groups of three digits."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
    return f"""WITH o AS (SELECT {listed(ones)} AS ones, {listed(tens)} AS tens),
 lo AS (SELECT k, CASE WHEN k = 0 THEN '' WHEN k < 20 THEN ones[k] WHEN k % 10 = 0 THEN tens[k // 10 - 1] ELSE {below_100} END AS w FROM range(100) r(k), o),
 sm AS (SELECT h * 100 + k AS g, CASE WHEN h = 0 THEN w WHEN k = 0 THEN ones[h] || ' {hundred}' ELSE ones[h] || ' {hundred}' || {after_hundred} || w END AS w FROM lo, range(10) r(h), o),
 n AS (SELECT o_orderkey AS key, o_orderkey * 37 // 1000000 AS m, o_orderkey * 37 // 1000 % 1000 AS t, o_orderkey * 37 % 1000 AS r FROM orders),
 p AS (SELECT key, m + t AS higher, r, concat_ws(' ', CASE WHEN m > 0 THEN a.w || ' {units[0]}' END, CASE WHEN t > 0 THEN b.w || ' {units[1]}' END) AS head, c.w AS tail FROM n JOIN sm a ON a.g = m JOIN sm b ON b.g = t JOIN sm c ON c.g = r)
 SELECT key::VARCHAR AS utt, 1 AS pos, CASE WHEN r + higher = 0 THEN '{zero}' WHEN r = 0 THEN head WHEN higher = 0 THEN tail WHEN {link} ELSE head || ' ' || tail END AS word FROM p"""


ENGLISH = _spoken(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", "twenty thirty forty fifty sixty seventy eighty ninety",
    "tens[k // 10 - 1] || ' ' || ones[k % 10]", "hundred", "' and '", ("million", "thousand"), "r < 20 OR (r < 100 AND r % 10 > 0) THEN head || ' and ' || tail", "zero",
)
AFRIKAANS = _spoken(
    "een twee drie vier vyf ses sewe agt nege tien elf twaalf dertien veertien vyftien sestien sewentien agtien negentien", "twintig dertig veertig vyftig sestig sewentig tagtig negentig",
    "ones[k % 10] || ' en ' || tens[k // 10 - 1]", "honderd", "CASE WHEN k < 20 THEN ' en ' ELSE ' ' END", ("miljoen", "duisend"), "r < 20 THEN head || ' en ' || tail", "nul",
)


@query("x6_verbalise_numbers_en", ENGLISH)
def x6(s, sf):
    return x.verbalise(_numbers(s, sf), "en", "expand")


@query("x7_verbalise_numbers_af", AFRIKAANS)
def x7(s, sf):
    return x.verbalise(_numbers(s, sf), "af")


@query("x8_group_phrase", "WITH g AS (SELECT rec, list(utt ORDER BY utt) AS u FROM v_segments GROUP BY rec) SELECT rec, CASE WHEN len(u) = 1 THEN u[1] ELSE array_to_string(u[:len(u) - 1], ', ') || ' and ' || u[len(u)] END AS phrase FROM g")
def x8(s, sf):
    return v.segments(s, sf).groupBy("rec").agg(ordered_list(["utt"], "utt").alias("u")).select("rec", x.enumerate_phrase(c("u")).alias("phrase"))


@query("x9_token_spans", "SELECT doc_id AS id, 'mail' AS kind, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+@[a-z.]+')) FROM documents) GROUP BY 1 UNION ALL SELECT doc_id, 'number', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) FROM documents) GROUP BY 1")
def x9(s, sf):
    return x.token_spans(table(s, sf, "documents"), "doc_id", "text", {"mail": "[a-z]+@[a-z.]+", "number": "[0-9]+"}).groupBy("id", "kind").agg(F.count("*").alias("n"))


def _two(col):
    """The first two words, empty if there are none: the rest of a text is not cut."""
    return F.array(*[F.regexp_extract(F.lower(col), "^[^a-z]*([a-z]+)[^a-z]+([a-z]+)", i) for i in (1, 2)])


@query("x10_extract_abbreviations", "SELECT doc_id AS id, upper(w[1][1] || w[2][1]) AS short, w[1] || ' ' || w[2] AS long FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) WHERE len(w) >= 2 AND length(w[1] || w[2]) > 1 AND NOT contains(w[1][2:] || w[2][2:], w[1][1]) AND NOT contains(w[2][2:], w[2][1])")
def x10(s, sf):
    d = table(s, sf, "documents").select("doc_id", F.translate("text", "()", "").alias("text"), _two("text").alias("w")).filter("w[1] <> ''").filter("not contains(concat(substring(w[0], 2), substring(w[1], 2)), substring(w[0], 1, 1)) and not contains(substring(w[1], 2), substring(w[1], 1, 1))")
    short = F.upper(F.concat(F.substring(c("w")[0], 1, 1), F.substring(c("w")[1], 1, 1)))
    return x.abbreviations(d.select("doc_id", F.concat("text", F.lit(" "), c("w")[0], F.lit(" "), c("w")[1], F.lit(" ("), short, F.lit(") ")).alias("t")), "doc_id", "t")


@query("x11_seconds_to_hms", "SELECT event_id, (start_cs // 100) // 3600 || ':' || lpad(((start_cs // 100) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(((start_cs // 100) % 60)::VARCHAR, 2, '0') AS hms FROM v_labelseg")
def x11(s, sf):
    return v.labelseg(s, sf).select("event_id", x.seconds_to_hms(c("start_cs") / 100).alias("hms"))


@query("x12_centisecond_id", "SELECT utt, rec || '_' || lpad(floor(round(start * 100, 3))::BIGINT::VARCHAR, 6, '0') || '_' || lpad(floor(round(\"end\" * 100, 3))::BIGINT::VARCHAR, 6, '0') AS id FROM v_segments")
def x12(s, sf):
    return v.segments(s, sf).select("utt", x.centisecond_id(c("rec"), c("start"), c("end")).alias("id"))


@query("x13_parse_hms", "SELECT event_id, (start_cs // 100)::DOUBLE AS seconds FROM v_labelseg")
def x13(s, sf):
    return v.labelseg(s, sf).select("event_id", x.parse_hms(x.seconds_to_hms(c("start_cs") / 100)).alias("seconds"))


@query("x16_grid_state", "SELECT event_id, CASE event_type WHEN 'view' THEN 'r' WHEN 'click' THEN 'D' WHEN 'error' THEN 'F' ELSE 'error' END AS state FROM events")
def x16(s, sf):
    out = F.when(c("event_type") == "view", "job 1\nstate: r").when(c("event_type") == "click", "failed 0\nexit_status 0").when(c("event_type") == "error", "failed 0\nexit_status 1").otherwise("")
    return table(s, sf, "events").select("event_id", x.grid_state(out).alias("state"))


@query("a6_job_tickets", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_keys(props)[1] AS first FROM events")
def a6(s, sf):
    return table(s, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.json_object_keys("props")[0].alias("first"))


@query("a7_tsv_multimap", "SELECT spk AS key, string_agg(utt, ' ' ORDER BY utt) AS vals FROM v_utt2spk GROUP BY spk")
def a7(s, sf):
    from ..sources.tables import multimap

    lines = v.utt2spk(s, sf).select(F.concat("spk", F.lit("\t"), "utt").alias("value"))
    return multimap(lines).select("key", F.array_join("vals", " ").alias("vals"))


@query("a10_segment_lines", "SELECT utt || ' ' || rec || ' ' || printf('%.2f', start) || ' ' || printf('%.2f', \"end\") AS value FROM v_segments")
def a10(s, sf):
    from ..sources.tables import segment_lines

    return segment_lines(v.segments(s, sf))


@query("a12_transcript_html", "SELECT utt, string_agg(CASE WHEN conf > 0.8 THEN word WHEN conf > 0.4 THEN '<span style=\"color:orange\">' || word || '</span>' ELSE '<span style=\"color:red\">' || word || '</span>' END, ' ' ORDER BY pos) AS html FROM v_ctm GROUP BY utt")
def a12(s, sf):
    from ..sources.tables import transcript_html

    return transcript_html(v.ctm(s, sf))


@query("a12_editor_html", """WITH w AS (SELECT utt, string_agg('<time datetime="' || printf('%.2f', start) || '">' || CASE WHEN conf > 0.8 THEN word WHEN conf > 0.4 THEN '<conf style="background-color: #FFA500">' || word || '</conf>' ELSE '<conf style="background-color: #FF0000">' || word || '</conf>' END || '</time>', ' ' ORDER BY pos) AS w FROM v_ctm WHERE length(utt) % 3 > 0 GROUP BY utt),
 g AS (SELECT rec, utt, start, CASE WHEN length(utt) % 2 = 0 THEN '<p>kept</p>' WHEN w IS NOT NULL THEN '<p> ' || w || ' </p>' ELSE '<p><span style="color: #FF0000;">Sorry could not recognise this audio section!</span></p>' END AS h FROM v_segments LEFT JOIN w USING (utt))
 SELECT rec, string_agg('<time type="mark" datetime="' || printf('%.2f', start) || '"></time>' || chr(10) || chr(10) || h, chr(10) || chr(10) ORDER BY start, utt) AS html FROM g GROUP BY rec""")
def a12_editor(s, sf):
    from ..sources.tables import editor_html

    seg = v.segments(s, sf).select("rec", c("utt").alias("seg"), "start", F.when(F.length("utt") % 2 == 0, "<p>kept</p>").otherwise("").alias("html"))
    words = v.ctm(s, sf).filter(F.length("utt") % 3 > 0).select(F.split("utt", "-")[0].alias("rec"), c("utt").alias("seg"), "pos", c("start").alias("at"), "word", "conf")
    return editor_html(seg, words)
