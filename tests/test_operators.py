"""Operators on literal fixtures, and sequential rules against brute force."""

import random

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import aggs, directories, intervals, joins, lexical, maps, scoring
from parlance.sources import tables

PAIRS = [("A", "A"), ("<eps>", "A"), ("B", "B"), ("C", "<eps>"), ("D", "D"), ("E", "X")]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("UTT-A", i, 0, a if a == "<eps>" else f"word-{a}", b if b == "<eps>" else f"word-{b}") for i, (a, b) in enumerate(PAIRS)], "utt string, pos int, k int, ref string, hyp string")


def test_ctm_conversion(spark):
    ctm = spark.createDataFrame([("utt", "1", 8.0, 1.0, "word", 0.5)], "utt string, channel string, start double, dur double, word string, conf double")
    seg = spark.createDataFrame([("utt", "reco", 10.0, 20.0)], "utt string, rec string, start double, end double")
    out = joins.ctm_to_recording(ctm, seg, spark.createDataFrame([("reco", "file", "A")], "rec string, file string, channel string")).first()
    assert (out["file"], out["channel"], out["start"], out["dur"], out["word"], out["conf"], out["past_end"]) == ("file", "A", 18.0, 1.0, "word", 0.5, False)


def test_edit_counts_and_rates(spark, pairs):
    k = aggs.edit_counts(pairs)
    assert tuple(k.first()) == ("UTT-A", 3, 1, 1, 1)
    r = {x["spk"]: x for x in aggs.wer_by_speaker(k, spark.createDataFrame([("UTT-A", "A")], "utt string, spk string")).collect()}
    for who in ("A", "SUM"):
        x = r[who]
        assert (x["n_sent"], x["n_word"], x["c"], x["s"], x["i"], x["d"], x["err"], x["sent_err"]) == (1, 5, 3, 1, 1, 1, 3, 1)
        assert (x["c_pct"], x["s_pct"], x["err_pct"], x["sent_err_pct"]) == (60.0, 20.0, 60.0, 100.0)
    ops = {(x["ref"], x["hyp"]): x["op"] for x in aggs.edit_op_table(pairs).collect()}
    assert ops[("word-E", "word-X")] == "substitution" and ops[("<eps>", "word-A")] == "insertion" and ops[("word-C", "<eps>")] == "deletion"


def test_alignment_has_the_edit_distance(spark):
    rng = random.Random(4)
    rows = [(str(i), [rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for i in range(60)]
    df = spark.createDataFrame(rows, "utt string, r array<string>, h array<string>")
    out = scoring.align(df.select("utt", F.col("r").alias("words")), df.select("utt", F.col("h").alias("words"))).orderBy("utt", "pos").collect()
    want = {r["utt"]: r["d"] for r in df.select("utt", F.levenshtein(F.array_join("r", ""), F.array_join("h", "")).alias("d")).collect()}
    for utt, r, h in rows:
        own = [(x["ref"], x["hyp"]) for x in out if x["utt"] == utt]
        assert [a for a, _ in own if a != "<eps>"] == r and [b for _, b in own if b != "<eps>"] == h
        assert sum(a != b for a, b in own) == want[utt]


def test_token_map_and_errors(spark):
    df = spark.createDataFrame([("l", ["A", "B"])], "k string, t array<string>")
    m = spark.createDataFrame([("A", ["a1", "a2"]), ("B", ["b"])], "sym string, values array<string>")
    assert maps.map_tokens(df, m, "k", "t").first()["t"] == ["a1", "a2", "b"]
    with pytest.raises(Exception, match="no entry for B"):
        maps.map_tokens(df, m.filter("sym = 'A'"), "k", "t").collect()


def test_spread_subset_equals_recursion(spark):
    def recursion(n, k, lo=0):
        if k == 0:
            return []
        if k == n:
            return list(range(lo, lo + n))
        return recursion(n // 2, k // 2, lo) + recursion(n - n // 2, k - k // 2, lo + n // 2)

    for n, k in ((50, 7), (64, 64), (33, 5)):
        df = spark.range(n).withColumnRenamed("id", "x")
        want = recursion(n, k)
        if len(want) == k and max(want, default=0) < n:
            assert sorted(r["x"] for r in maps.subset(df, k, "x", "spread").collect()) == want


def test_min_gap_and_hit_clusters(spark):
    pts = [0.0, 1.0, 5.0, 9.9, 10.0, 11.0, 20.0]
    assert [r["at"] for r in intervals.min_gap(spark.createDataFrame([("r", p) for p in pts], "rec string, at double"), 5.0).orderBy("at").collect()] == [0.0, 5.0, 10.0, 20.0]
    hits = [("k", "f", "1", t, 0.2, s) for t, s in ((0.0, 0.1), (0.4, 0.9), (0.6, 0.5), (2.0, 0.3))]
    got = directories.dedup_hits(spark.createDataFrame(hits, "kwid string, file string, channel string, tbeg double, dur double, score double")).orderBy("tbeg").collect()
    assert [r["tbeg"] for r in got] == [0.4, 0.6, 2.0]


def test_numbers_in_words():
    phrases = {
        -1234: "negative one thousand, two hundred thirty-four", -1: "negative one", 0: "zero", 1: "one", 8: "eight", 18: "eighteen", 28: "twenty-eight", 280: "two hundred eighty",
        2800: "two thousand, eight hundred", 280028: "two hundred eighty thousand, twenty-eight", 2800000: "two million, eight hundred thousand",
    }
    last = {-1234: "fourth", -1: "first", 0: "zeroth", 1: "first", 8: "eighth", 18: "eighteenth", 28: "eighth", 280: "eightieth", 2800: "hundredth", 280028: "eighth", 2800000: "thousandth"}
    for n, phrase in phrases.items():
        assert tx.english(n, "cardinal", ", ", "-") == phrase
        assert tx.english(n) == phrase.replace(",", "").replace("-", " ")
        ordinal = tx.english(n, "ordinal", ", ", "-")
        assert ordinal == phrase[: -len(re.split("[ -]", phrase)[-1])] + last[n]
    expanded = {1020: "one thousand twenty", 1021: "one thousand and twenty one", 1005: "one thousand and five", 1010: "one thousand and ten", 1280: "one thousand two hundred and eighty", 101: "one hundred and one"}
    assert {n: tx.english(n, "expand") for n in expanded} == expanded
    assert [tx.english(n, "ordinal") for n in (20, 21, 32, 12)] == ["twentieth", "twenty first", "thirty second", "twelfth"]
    spoken = {21: "een en twintig", 101: "een honderd en een", 1000: "een duisend", 280: "twee honderd tagtig", 1005: "een duisend en vyf", 101000: "een honderd en een duisend", 121: "een honderd een en twintig"}
    assert {n: tx.afrikaans(n) for n in spoken} == spoken
    assert [tx.afrikaans(n, "ordinal") for n in (1, 3, 4, 7, 8, 9, 14, 20)] == ["eerste", "derde", "vierde", "sewende", "agtste", "negende", "veertiende", "twintigste"]


def test_enumeration(spark):
    df = spark.createDataFrame([(0, []), (1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"])], "i int, x array<string>")
    assert [r["p"] for r in df.orderBy("i").select(tx.enumerate_phrase(F.col("x")).alias("p")).collect()] == ["", "a", "a and b", "a, b and c"]


def test_lexicon_disambiguation(spark):
    lx = [("demi", "d e m i"), ("demit", "d e m i t"), ("demitasse", "d e m i t a s"), ("is", "i s"), ("iss", "i s")]
    df = spark.createDataFrame([(w, p.split()) for w, p in lx], "word string, phones array<string>")
    got = {r["word"]: r["pron"] for r in lexical.disambiguate(df).collect()}
    assert got == {"demi": "d e m i #1", "demit": "d e m i t #1", "demitasse": "d e m i t a s", "is": "i s #1", "iss": "i s #2"}


def test_rule_hierarchy_and_candidates(spark):
    rules = spark.createDataFrame([("RED", "RE", "D", ""), ("ED", "E", "D", ""), ("D", "", "D", "")], "suffix string, base_suffix string, psuffix string, base_psuffix string")
    got = {(r["specific"], r["general"]) for r in lexical.rule_hierarchy(rules).collect()}
    assert got == {("RED,RE,D,", "ED,E,D,"), ("RED,RE,D,", "D,,D,"), ("ED,E,D,", "D,,D,")}
    cand = lexical.candidate_prons(
        spark.createDataFrame([("WASTED",)], "word string"), spark.createDataFrame([("STED", "STING", "S_T_AH0_D", "S_T_IH0_NG")], rules.schema),
        spark.createDataFrame([("WASTING", "W EY1 S T IH0 NG".split())], "word string, phones array<string>"), min_prefix=2,
    )
    assert cand.select("pron").first()[0] == "W EY1 S T AH0 D"


def test_corpus_files_round_trip(spark, tmp_path):
    (tmp_path / "segments").write_text("u1 r 0.5 1.25\nu2 r x 2\n\nu3 r 1 2 3\n")
    good, bad = tables.read_table(spark, str(tmp_path / "segments"), "segments")
    assert [tuple(r) for r in good.collect()] == [("u1", "r", 0.5, 1.25)] and bad.count() == 2
    (tmp_path / "ctm").write_text("u 1 0.5 0.2 hi\nu 1 0.9 0.2 you 0.75\n")
    ctm, _ = tables.read_table(spark, str(tmp_path / "ctm"), "ctm")
    assert [r["value"] for r in tables.ctm_lines(ctm).collect()] == ["u 1 0.50 0.20 hi", "u 1 0.90 0.20 you 0.75"]
    (tmp_path / "a.TextGrid").write_text('intervals [1]:\n xmin = 0 \n xmax = 1.5 \n text = "V" \n intervals [2]:\n xmin = 1.5\n xmax = 2\n text = "U"\n')
    assert [(r["start"], r["end"], r["label"]) for r in tables.read_textgrid(spark, str(tmp_path / "a.TextGrid")).collect()] == [(0.0, 1.5, "V"), (1.5, 2.0, "U")]
    (tmp_path / "lm.arpa").write_text("x\n\\data\\\nngram 1=2\nngram 2=1\n\n\\1-grams:\n-1.0 a -0.5\n-2.0 b\n\n\\2-grams:\n-0.25 a b\n\n\\end\\\n")
    arpa = tables.read_arpa(spark, str(tmp_path / "lm.arpa"))
    assert sorted((r["n"], r["words"], r["logprob"], r["backoff"]) for r in arpa.collect()) == [(1, ["a"], -1.0, -0.5), (1, ["b"], -2.0, None), (2, ["a", "b"], -0.25, None)]
    lines = [r["value"] for r in tables.arpa_lines(arpa).orderBy("ord").collect()]
    assert lines[:3] == ["\\data\\", "ngram 1=2", "ngram 2=1"] and lines[-1] == "\\end\\" and "-0.250000\ta b" in lines
    (tmp_path / "d.1.log").write_text("# Accounting: time=12 threads=4\nWARNING x\n")
    (tmp_path / "d.2.log").write_text("ERROR y\n# Accounting: time=3 threads=1\n")
    s = aggs.log_summary(tables.scan_logs(spark, str(tmp_path))).first()
    assert tuple(s) == ("d.*.log", 1, 1, 51, 5)
    assert {r["id"] for r in tables.list_recordings(spark, str(tmp_path), "*.TextGrid").collect()} == {"a"}


def test_keyword_list_xml_round_trip(spark, tmp_path):
    hits = [("K1", "f", "1", 1.0, 0.5, 0.9, "YES"), ("K1", "g", "1", 2.0, 0.5, 0.2, "NO"), ("K2", "f", "1", 3.0, 0.5, 0.4, "NO")]
    df = spark.createDataFrame(hits, "kwid string, file string, channel string, tbeg double, dur double, score double, decision string")
    tables.write_kwslist(df, str(tmp_path / "kws"))
    assert sorted(tuple(r) for r in tables.read_kwslist(spark, str(tmp_path / "kws")).collect()) == hits


def test_transcripts_of_pages(spark):
    text, places = tx.html_with_map('<p>A&amp;b<time type="mark">x</time><br>c</p>')
    assert text.strip() == "A&b c" and len(places) == len(text)
    pages = tx.insert_tags(spark.createDataFrame([(1, "abcdef"), (2, "z")], "id long, html string"), spark.createDataFrame([(1, 4, "<t>"), (1, 2, "<s>")], "id long, at int, tag string"))
    assert {r["id"]: r["html"] for r in pages.collect()} == {1: "ab<s>cd<t>ef", 2: "z"}
    silent = tables.index_html(spark.createDataFrame([("r", 1.0)], "rec string, start double"), spark.createDataFrame([("r",), ("q",)], "rec string"))
    got = {r["rec"]: r["html"] for r in silent.collect()}
    assert 'datetime="1.00"' in got["r"] and "No silences" in got["q"]


def test_syllables_to_phones(spark):
    df = spark.createDataFrame([("zhang1",), ("an4",)], "s string")
    got = [r["phones"] for r in maps.syllable_phones(df, "s", {"zh": "JH"}, {"ang": ["AA", "NG"], "an": ["AE", "N"]}).collect()]
    assert got == [["JH", "AA1", "NG1"], ["AE4", "N4"]]


def test_reversed_model_scores_reversed_sentences(spark):
    import itertools

    grams = [(1, ["<s>"], -99.0, -0.4), (1, ["</s>"], -0.9, None), (1, ["a"], -0.5, -0.3), (1, ["b"], -0.7, -0.2), (1, ["c"], -1.1, -0.1)]
    grams += [(2, ["<s>", "a"], -0.2, None), (2, ["a", "b"], -0.3, None), (2, ["b", "</s>"], -0.25, None), (2, ["b", "a"], -0.6, None), (2, ["a", "</s>"], -0.8, None), (2, ["<s>", "c"], -0.35, None)]
    rev = lexical.reverse_arpa(spark.createDataFrame(grams, "n int, words array<string>, logprob double, backoff double")).collect()

    def score(model, words):
        total = 0.0
        for v, w in itertools.pairwise(words):
            if (v, w) in model:
                total += model[v, w][0]
            else:
                total += (model[(v,)][1] or 0.0) + model[(w,)][0]
        return total

    forward = {tuple(w): (p, b) for _, w, p, b in grams}
    backward = {tuple(r["words"]): (r["logprob"], r["backoff"]) for r in rev}
    for n in range(1, 4):
        for s in itertools.product("abc", repeat=n):
            assert abs(score(forward, ["<s>", *s, "</s>"]) - score(backward, ["<s>", *reversed(s), "</s>"])) < 1e-9, s


def test_edit_path_of_long_texts_is_bounded_in_memory():
    import tracemalloc

    import numpy as np

    from parlance.operators.scoring import EPS, edit_path

    def whole_table(ref, hyp):
        d = [[i + j for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
        for i, x in enumerate(ref, 1):
            for j, y in enumerate(hyp, 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
        out, i, j = [], len(ref), len(hyp)
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
                i, j = i - 1, j - 1
                out.append((ref[i], hyp[j]))
            elif i and d[i][j] == d[i - 1][j] + 1:
                i -= 1
                out.append((ref[i], EPS))
            else:
                j -= 1
                out.append((EPS, hyp[j]))
        return out[::-1]

    rng = np.random.default_rng(1)
    for _ in range(300):
        ref, hyp = (list(rng.choice(list("abcd"), int(rng.integers(0, 30)))) for _ in range(2))
        assert edit_path(ref, hyp) == whole_table(ref, hyp)
    ref = [f"w{x}" for x in rng.integers(0, 500, 3000)]
    hyp = [x for i, x in enumerate(ref) if i % 7]
    tracemalloc.start()
    assert len(edit_path(ref, hyp)) == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000  # the whole table has 3001 x 2572 numbers of four bytes, 31 MB


def test_plain_text_equals_text_of_the_map():
    rng = random.Random(6)
    parts = ["<p>", "</p>", "<br/>", '<time type="mark" datetime="1">', "</time>", "<b class=x>", "a b", "\t\n", "\x07", "\x85", "\u00a0", "&amp;", "&#9;", "&#32;", "&nosuch;", "&", "<", "<li>", " ", "\u4e2d\u6587", "&lt;p&gt;", "\x1c"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert tx.html_plain(page) == tx.html_with_map(page)[0]


def test_in_place_maps_equal_joins(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(str(i % 6), [rng.choice("abcdef") for _ in range(rng.randrange(6))]) for i in range(12)] + [("none", [])]
    df = spark.createDataFrame(rows, "k string, t array<string>")
    m = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["z"])], "sym string, values array<string>")
    ids = spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "sym string, id int")
    both = {}
    for way in ("in place", "joined"):
        if way == "joined":
            monkeypatch.setattr(maps, "lookup", lambda df, rows=0: None)
        mapped = [maps.map_tokens(df, m, "k", "t", first, last, True) for first, last in ((1, None), (2, 3))]
        numbered = maps.symbols_to_ids(df, ids, "k", "t", oov=9)
        named = maps.ids_to_symbols(maps.symbols_to_ids(df.withColumn("t", F.filter("t", lambda w: w <= "d")), ids, "k", "t"), ids, "k", "ids")
        both[way] = [sorted(map(str, x.collect())) for x in (*mapped, numbered, named)]
    assert both["in place"] == both["joined"] and len(both["joined"][0]) == len(rows)


def counted(df):
    """``df`` through a step that counts the rows it hands on, and that count."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_reversed_models_are_made_from_one_reading(spark):
    grams = [(1, ["a"], -0.5, -0.3), (1, ["b"], -0.7, -0.2), (2, ["a", "b"], -0.3, None), (3, ["a", "b", "a"], -0.6, None)]
    model, seen = counted(spark.createDataFrame(grams, "n int, words array<string>, logprob double, backoff double"))
    assert lexical.reverse_arpa(model).count() > len(grams) and seen.value == len(grams)


def test_ngrams_of_short_texts_and_nulls(spark):
    text = spark.createDataFrame([("u", ["a", "b", "a", "b"]), ("v", ["a"]), ("w", []), ("x", None)], "utt string, words array<string>")
    assert {tuple(r) for r in lexical.ngrams(text, 2).collect()} == {("a b", 2), ("b a", 1)}
    assert lexical.ngrams(text, 5).count() == 0


def test_segments_of_aligned_stream_their_rows(spark):
    rng = random.Random(4)
    rows = [(f"u{u}", i, i * 0.4, rng.choice([0.4, 0.6]), *rng.choice([("<eps>", "<eps>"), ("a", "a"), ("a", "b"), ("a", "a")])) for u in range(6) for i in range(200)]
    rng.shuffle(rows)
    out = intervals.segments_of_aligned(spark.createDataFrame(rows, "utt string, pos int, start double, dur double, ref string, hyp string"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # a recording is no value of a task
    want = []
    for u in sorted({r[0] for r in rows}):
        pieces, own = [], []
        for _, _, s, d, r, h in sorted(x for x in rows if x[0] == u):
            pause = r == h == "<eps>"
            if own and (pause and d >= 0.5 or s + d - own[0][0] > 10.0):
                pieces, own = [*pieces, own], []
            if own or not pause:
                own.append((s, d, r, h))
        for p in [*pieces, own]:
            while p and p[-1][2] == p[-1][3] == "<eps>":
                p.pop()
            n, err = sum(x[2] != "<eps>" for x in p), sum(x[2] != x[3] for x in p)
            if p and err <= 0.5 * n and p[-1][0] + p[-1][1] + 0.25 - max(0.0, p[0][0] - 0.25) >= 2.0:
                want.append((u, round(max(0.0, p[0][0] - 0.25), 2), round(p[-1][0] + p[-1][1] + 0.25, 2), n, err, " ".join(x[2] for x in p if x[2] != "<eps>")))
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and want


def test_abbreviations_look_back_from_the_bracket(spark):
    import time

    rng = random.Random(2)
    shape = re.compile(r"([^()]{2,200})\(([A-Za-z][A-Za-z0-9.-]{1,9})\)")
    texts = ["".join(rng.choice(["large ", "text ", "LT", "(LT)", "(", ")", " " * 150, "x"]) for _ in range(60)) for _ in range(200)]
    want = [(i, m[2], tx.long_form(m[2], m[1])) for i, t in enumerate(texts) for m in shape.finditer(t) if tx.long_form(m[2], m[1]) is not None]
    got = tx.abbreviations(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and want
    long = spark.range(1).select("id", F.repeat(F.lit("word "), 4_000_000).alias("text"))
    began = time.time()
    assert tx.abbreviations(long, "id", "text").count() == 0
    assert time.time() - began < 8  # a text without brackets is not tried at each of its places


def test_silence_factors_count_the_words_once(spark):
    rows = [("u", i, w, "") for i, w in enumerate(["a", "<eps>", "b", "a", "b", "<eps>", "b"])]
    prons, seen = counted(spark.createDataFrame(rows, "utt string, pos int, word string, pron string"))
    n = aggs.silence_neighbours(prons)
    got = aggs.silence_correction(aggs.silence_probs(n), n, lexical.pron_bigrams(spark.createDataFrame(rows, prons.schema)))
    assert {r["word"] for r in got.collect()} >= {"a", "b"} and seen.value == len(rows)


def test_lexicon_checks_read_the_lexicon_once(spark):
    rows = [("a", ["x"], 1.5), ("a", ["x"], 0.5), ("b", ["q"], 0.5), ("c", [], 0.5)]
    lexicon, seen = counted(spark.createDataFrame(rows, "word string, phones array<string>, prob double"))
    got = directories.validate_lexicon(lexicon, spark.createDataFrame([("s",)], "phone string"), spark.createDataFrame([("x",)], "phone string"))
    assert {tuple(r) for r in got.collect()} == {("repeated entry", "a"), ("empty pronunciation", "c"), ("unknown phone", "q"), ("probability", "a")}
    assert seen.value == len(rows)


def test_arpa_lines_read_the_model_once(spark):
    grams = [(1, ["a"], -0.5, -0.3), (1, ["b"], -0.7, -0.2), (2, ["a", "b"], -0.3, None)]
    model, seen = counted(spark.createDataFrame(grams, "n int, words array<string>, logprob double, backoff double"))
    lines = [r["value"] for r in tables.arpa_lines(model).orderBy("ord").collect()]
    assert lines[:3] == ["\\data\\", "ngram 1=2", "ngram 2=1"] and seen.value == len(grams)


def test_the_lexicon_is_written_once(spark):
    from parlance.plans import adapters

    lexicon = adapters.lexicon(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in lexicon._jdf.queryExecution().toString()  # a scan: no use of it cuts the texts again
    assert lexicon.count() == adapters.words(spark, "/root/testdata/sf0.001").select("word").distinct().count()


def test_pretty_lines_gather_pairs_once(spark, pairs):
    out = scoring.pretty(pairs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    assert len({len(out.first()[x]) for x in ("ref", "hyp", "op")}) == 1


def test_alignments_made_together_equal_single_ones(spark, monkeypatch):
    rng = random.Random(11)
    made = lambda: [rng.choice("abcdef") for _ in range(rng.choice([0, 1, 5, 62, 63, 64, 65, 150]))]
    rows = [(str(i), made(), made()) for i in range(120)] + [("eps", ["<eps>", "a", "b"], ["a", "<eps>", "b"]), ("none", None, ["a"]), ("null", ["a", None, "c"], ["b", None, "d"])]
    df = spark.createDataFrame(rows, "utt string, r array<string>, h array<string>")
    monkeypatch.setattr(scoring, "FEW", 1)  # before, every pair went through the single form, and counts through rows of pairs
    numbers = [[np.array([ord(x) for x in side], int) for side in (r, h)] for _, r, h in rows[:120]]
    kinds = {(True, False): scoring.REF, (False, True): scoring.HYP, (False, False): scoring.PAIR}
    for (r, h), got in zip(numbers, scoring.edit_moves(*zip(*numbers))):
        assert got.tolist() == [kinds[y is scoring.EPS, x is scoring.EPS] for x, y in scoring.edit_path(r.tolist(), h.tolist())]
    pairs = scoring.align_rows(df)
    counts = {tuple(x) for x in scoring.error_rows(df).collect() if sum(x[1:])}
    assert counts == {tuple(x) for x in aggs.edit_counts(pairs).collect()} and len(counts) > 120 - 10


def test_sides_within_rows_equal_gathered_pairs(spark):
    from parlance.operators.helpers import ordered_list
    from parlance.plans import adapters as v

    pairs = v.pairs(spark, "/root/testdata/sf0.001")
    want = [{x["utt"]: x["w"] for x in pairs.filter(f"{side} <> '<eps>'").groupBy("utt").agg(ordered_list(["pos", "k"], side).alias("w")).collect()} for side in ("ref", "hyp")]
    got = v.sides(spark, "/root/testdata/sf0.001").collect()
    assert [{x["utt"]: x[side] for x in got} for side in "rh"] == want


def test_cut_runs_equal_brute_force_in_one_sort(spark):
    rng = random.Random(5)
    rows = []
    for rec in range(12):
        at = 0
        for _ in range(60):
            at += rng.choice([0, 1, 7, 50, 400])
            rows.append((str(rec), rng.choice("ab") if rng.random() < 0.1 or not rows else rows[-1][1], at, at + rng.choice([0, 3, 90])))
    df = spark.createDataFrame(rows, "rec string, label string, start_cs long, end_cs long")
    out = intervals.split_long_runs(df, 100)
    want = []
    for rec in {x[0] for x in rows}:
        own = sorted(((s, e, la) for r, la, s, e in rows if r == rec))
        runs = [[own[0]]]
        for x in own[1:]:
            runs[-1].append(x) if runs[-1][-1][2] == x[2] else runs.append([x])
        for run in runs:
            a, b, starts = run[0][0], run[-1][1], [x[0] for x in run]
            n = max(1, -((a - b) // 100))
            points = sorted({a} | {min((s for s in starts if s > a + (b - a) * k / n), default=starts[-1]) for k in range(1, n)})
            want += [(rec, run[0][2], s, e) for s, e in zip(points, [*points[1:], b])]
    assert sorted(tuple(x) for x in out.collect()) == sorted(want) and len(want) > 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # before, each branch of rows, runs and cuts sorted all rows again in one task
