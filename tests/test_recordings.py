"""Ordered rules against plain loops, look-ups on both paths, balanced parts, and streams that get their rows late or out of order."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import directories, helpers, index, intervals, lexical, maps, recordings, scoring
from parlance.plans import q_language
from parlance.sources import tables
from parlance.streaming import stateful, streams


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# --- look-ups: one result whatever the size of the table

SMALL_OR_NOT = [100_000, -1]


@pytest.mark.parametrize("in_place", SMALL_OR_NOT)
def test_mapped_tokens_on_both_paths(spark, in_place):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (1, ["b", "q"]), (3, None)], "k long, words array<string>")
    table = spark.createDataFrame([("a", ["x"]), ("a", ["x"]), ("b", ["y", "z"]), (None, ["n"])], "sym string, values array<string>")
    got = maps.map_tokens(df, table, "k", "words", permissive=True, in_place=in_place)
    assert rows(got, "k", "words") == sorted([(1, ["x", None, "y", "z"]), (1, ["y", "z", "q"]), (2, []), (3, [])], key=str)
    ranged = maps.map_tokens(df, table, "k", "words", 2, 2, True, in_place)
    assert rows(ranged, "k", "words") == sorted([(1, ["a", None, "b"]), (1, ["b", "q"]), (2, []), (3, [])], key=str)
    with pytest.raises(Exception, match="no entry for q"):
        maps.map_tokens(df, table, "k", "words", in_place=in_place).collect()
    with pytest.raises(Exception, match="two entries"):
        maps.map_tokens(df, table.union(spark.createDataFrame([("a", ["w"])], table.schema)), "k", "words", in_place=in_place).collect()


@pytest.mark.parametrize("in_place", SMALL_OR_NOT)
def test_symbols_and_ids_on_both_paths(spark, in_place):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (1, ["b", "q"])], "k long, words array<string>")
    table = spark.createDataFrame([("a", 5), ("a", 5), ("b", 7)], "sym string, id int")
    got = maps.symbols_to_ids(df, table, "k", "words", oov=1, in_place=in_place)
    assert rows(got, "k", "ids", "n_oov") == [(1, [5, 1, 7], 1), (1, [7, 1], 1)]
    back = maps.ids_to_symbols(spark.createDataFrame([(1, [5, 7, 5])], "k long, ids array<int>"), table, "k", "ids", in_place=in_place)
    assert rows(back, "k", "words") == [(1, ["a", "b", "a"])]
    for bad, kind in (([5, 9], "unknown id 9"), ([None], "unknown id")):
        with pytest.raises(Exception, match=kind):
            maps.ids_to_symbols(spark.createDataFrame([(1, bad)], "k long, ids array<int>"), table, "k", "ids", in_place=in_place).collect()
    with pytest.raises(Exception, match="unknown symbol"):
        maps.symbols_to_ids(df, table, "k", "words", in_place=in_place).collect()


def test_replacements_are_observed_while_written(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "q", "b"]), (2, []), (3, ["b"])], "k long, words array<string>")
    table = spark.createDataFrame([("a", 5), ("b", 7)], "sym string, id int")
    assert maps.write_ids(df, table, "k", "words", str(tmp_path / "ids"), 1) == {"n_rows": 2, "n_tokens": 4, "n_oov": 1, "n_rows_oov": 1}
    assert rows(spark.read.parquet(str(tmp_path / "ids")), "k", "ids") == [(1, [5, 1, 7]), (3, [7])]


def test_ids_beside_nulls_stay_exact(spark):
    big = 9007199254740993
    pages = spark.createDataFrame([(big, "<p>Word Error Rate (WER) 12</p>"), (None, "<p>x</p>"), (big + 2, None)], "id long, html string").coalesce(1)
    ids = {big, None, big + 2}
    for with_map in (False, True):
        assert {r["id"] for r in text.html_to_text(pages, "id", "html", with_map).collect()} == ids
    assert {r["id"] for r in text.token_spans(pages, "id", "html", {"n": "[0-9x]+"}).collect()} == {big, None}
    assert rows(text.abbreviations(pages, "id", "html"), "id", "short") == [(big, "WER")]


# --- parts of about equal load

def plain_balance(sizes, n):
    part = [i * n // len(sizes) for i in range(len(sizes))]
    load = [sum(x for x, p in zip(sizes, part) if p == q) for q in range(n)]
    changed = True
    while changed:
        changed = False
        for p in range(n - 1):
            own, other = [i for i, q in enumerate(part) if q == p], [i for i, q in enumerate(part) if q == p + 1]
            for i, a, b in ((own[-1], p, p + 1), (other[0], p + 1, p)):
                if part.count(a) > 1 and abs(load[a] - sizes[i] - load[b] - sizes[i]) < abs(load[a] - load[b]):
                    part[i], changed = b, True
                    load[a], load[b] = load[a] - sizes[i], load[b] + sizes[i]
                    break
    return [p + 1 for p in part]


@pytest.mark.parametrize("near", [1, 3, 512])
def test_balanced_parts_by_one_rule(spark, near):
    """Also where boundaries walk beyond the speakers that are held at first."""
    rng = random.Random(near)
    for sizes, n in (([1, 1, 1, 1, 9, 1, 1, 7, 2], 3), ([30] * 4 + [1] * 60, 4), ([rng.randint(1, 40) for _ in range(50)], 7), ([5, 1], 2), ([3], 1)):
        df = spark.createDataFrame([(f"s{i:03d}", x) for i, x in enumerate(sizes)], "spk string, n_utts long")
        got = {r["spk"]: r["part"] for r in directories.balance_parts(df, n, near).collect()}
        assert [got[k] for k in sorted(got)] == plain_balance(sizes, n)


# --- spliced words

def test_repeats_take_back_what_followed_them(spark):
    words = [(0.0, 0.4, "a"), (0.4, 0.4, "b"), (0.8, 0.4, "c"), (0.42, 0.4, "b"), (0.82, 0.3, "d"), (1.0, 0.2, "noise"), (1.5, 0.2, "e")]
    df = spark.createDataFrame([("u", "1", i, *w) for i, w in enumerate(words)], "utt string, channel string, pos int, start double, dur double, word string")
    got = [tuple(r)[2:] for r in recordings.splice_ctm(df).orderBy("start").collect()]
    assert got == [(0.0, 0.4, "a"), (0.4, 0.4, "b"), (0.8, 0.02, "<eps>"), (0.82, 0.3, "d"), (1.12, 0.38, "<eps>"), (1.5, 0.2, "e")]
    assert recordings.splice_ctm(df.limit(0)).count() == 0


# --- segments of aligned words

def plain_entries(ctm, pairs):
    out, at = [], 0
    for ref, hyp in pairs:
        if hyp == "<eps>":
            out.append([ref, out[-1][1] + out[-1][2] if out else 0.0, 0.0, 1])
            continue
        while ctm[at][2] == "<eps>":
            out.append(["<eps>", *ctm[at][:2], 0])
            at += 1
        start, dur, word = ctm[at]
        at += 1
        if ref == "<eps>" and out:
            out[-1][2] += dur
            out[-1][3] += 1
        else:
            out.append([ref, start, dur, int(ref != word)])
    return out


def plain_segments(x, longest, shortest, silence, cutoff):
    """The rule on a list that is all there, by places in it."""
    out = []

    def emit(a, b):
        while a <= b and x[a][0] == "<eps>":
            a += 1
        while b >= a and x[b][0] == "<eps>":
            b -= 1
        words = [e[0] for e in x[a : b + 1] if e[0] != "<eps>"]
        errors = sum(e[3] for e in x[a : b + 1])
        if a > b or errors > cutoff * len(words):
            return
        i = a
        while i and x[i - 1][0] == "<eps>":
            i -= 1
        j = b
        while j + 1 < len(x) and x[j + 1][0] == "<eps>":
            j += 1
        end = x[b][1] + x[b][2]
        lead, tail = min(silence / 2, (x[a][1] - x[i][1]) / 2), min(silence / 2, (x[j][1] + x[j][2] - end) / 2)
        out.append((round(x[a][1] - lead, 2), round(end + tail, 2), len(words), errors, " ".join(words)))

    def point(a, b, limit):
        fits = [k for k in range(a, b + 1) if x[k][1] + x[k][2] - x[a][1] <= limit]
        return fits[-1] if fits else a

    def force(a, b):
        size = x[b][1] + x[b][2] - x[a][1]
        while size > 1.5 * longest:
            k = point(a, b, longest)
            emit(a, k)
            a = k + 1
            size = x[b][1] + x[b][2] - x[a][1] if a <= b else 0
        if size > longest:
            k = point(a, b, size / 2 + 0.01)
            emit(a, k)
            a = k + 1
        if a <= b:
            k = point(a, b, longest + 0.01)
            emit(a, k)
            a = k + 1
        return a

    first = 0
    for i, (w, _, d, _) in enumerate(x):
        clean = (i == 0 or not x[i - 1][3]) and (i + 1 == len(x) or not x[i + 1][3])
        if w != "<eps>" or d <= silence or not clean:
            continue
        said = [e for e in x[first : i + 1] if e[0] != "<eps>"]
        size = said[-1][1] + said[-1][2] - said[0][1] if said else 0
        if size > longest:
            first = force(first, i)
        elif size >= shortest:
            emit(first, i)
            first = i + 1
    if first < len(x):
        force(first, len(x) - 1)
    return out


def test_segments_equal_a_plain_walk(spark):
    rng = random.Random(5)
    ctm_rows, pair_rows, want = [], [], {}
    for u in range(30):
        at, ctm, pairs = 0.0, [], []
        for _ in range(rng.randint(0, 220)):
            if rng.random() < (0.02 if u % 2 else 0.12):
                d = round(rng.choice([0.2, 0.4, 0.7, 1.1]), 2)
                ctm.append((round(at, 2), d, "<eps>"))
            else:
                word, d = rng.choice("abcdef"), round(rng.uniform(0.1, 0.6), 2)
                ctm.append((round(at, 2), d, word))
                kind = rng.random()
                pairs.append(("zz" if kind < 0.05 else "<eps>" if kind < 0.08 else word, word))
                if kind > 0.96:
                    pairs.append(("gone", "<eps>"))
            at += d
        ctm_rows += [(f"u{u}", i, *x) for i, x in enumerate(ctm)]
        pair_rows += [(f"u{u}", i, *x) for i, x in enumerate(pairs)]
        want[f"u{u}"] = plain_segments(plain_entries(ctm, pairs), 10.0, 2.0, 0.5, 0.2)
    ctm = spark.createDataFrame(ctm_rows, "utt string, pos long, start double, dur double, word string")
    pairs = spark.createDataFrame(pair_rows, "utt string, pos long, ref string, hyp string")
    got = {}
    for r in recordings.cut_aligned(ctm, pairs, wer_cutoff=0.2).orderBy("utt", "seg").collect():
        got.setdefault(r["utt"], []).append(tuple(r)[2:])
    assert got == {u: w for u, w in want.items() if w}
    assert all(b - a <= 10.01 + 0.5 + 0.01 for w in want.values() for a, b, *_ in w) and any(b - a > 9 for w in want.values() for a, b, *_ in w)
    bad = pairs.withColumn("hyp", F.when(F.col("pos") == 3, "other").otherwise(F.col("hyp")))
    with pytest.raises(Exception, match="differ"):
        recordings.cut_aligned(ctm, bad).collect()


# --- energy

def test_level_follows_the_recording(spark):
    """A loud first half and a quiet second: what is speech there is below the first level."""
    loud = [100.0 if i % 20 < 10 else 1.0 for i in range(400)]
    quiet = [10.0 if i % 20 < 10 else 0.1 for i in range(400)]
    frames = spark.createDataFrame([("r", i, v) for i, v in enumerate(loud + quiet)], "rec string, frame long, rms double")
    spans = [tuple(r)[1:] for r in recordings.energy_states(frames, window=100, extremes=20, least=30, gap=3).orderBy("first").collect()]
    fixed = recordings.energy_states(frames, window=10_000, extremes=20, least=30, gap=3).count()
    assert len(spans) == 40 and fixed == 20
    assert spans[0] == (0, 10) and spans[-1] == (780, 790)
    pitch = frames.withColumn("pitch", F.when(F.col("frame") < 405, 1).otherwise(0))
    assert recordings.pitched(spark.createDataFrame([("r", 0, 10), ("r", 400, 450), ("r", 400, 451)], "rec string, first long, last long"), pitch, 0.1, 7).count() == 1


# --- scores in place

def test_smoothed_scores_equal_all_pairs_and_make_none(spark):
    rng, window = random.Random(5), 40
    data = [(f"r{k % 3}", k, m, s, s + rng.choice([-90, -60, -20, 0, 1, 30, 500]), rng.choice([None, -0.1, 3e5, 1e-9])) for k in range(120) for s in [rng.randrange(900)] for m in "ab"]
    data.append(("r0", 999, "a", None, 5, 1.5))
    df = spark.createDataFrame(data, "rec string, event_id long, model string, start_cs long, end_cs long, score double")
    want = {}
    for rec, k, m, s, e, x in data:
        near = [(min(f, e + window) - max(t, s - window), y) for r, j, n, t, f, y in data if (r, n) == (rec, m) and j != k and None not in (s, t)]
        near = [(w, y) for w, y in near if w > 0]
        mean = sum(w * y for w, y in near if y is not None) / sum(w for w, _ in near) if near else 0
        want[rec, k, m] = None if x is None else pytest.approx(x + 0.5 * mean)
    out = intervals.smooth_scores(df, window, 0.5)
    assert {(r["rec"], r["event_id"], r["model"]): r["score"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # a table that grows with the pairs cannot be sent to the driver


def test_equal_costs_tie_whatever_their_last_bits(spark):
    n = spark.createDataFrame([("u", "m1", 0.1, 0.2, 1), ("u", "m2", 0.3, 0.0, 1)], "utt string, hyp string, lm double, ac double, n_words int")
    grid = spark.createDataFrame([(1, 0.0)], "lmwt int, penalty double")
    assert 0.1 + 0.2 > 0.3
    assert [r["hyp"] for r in scoring.nbest_pick(n, grid).collect()] == ["m1"]


def test_keyword_ids_of_five_digits_are_cut_as_in_the_sql(spark):
    ids = q_language._cut(spark.createDataFrame([("KW-0007",), ("KW-12345",)], "kwid string"))
    assert rows(ids, "kwid") == [("KW-0007",), ("KW-1234",)]


def test_a_word_that_begins_many_keywords_stays_one_row(spark, tmp_path):
    phrases = [f"a w{i}" for i in range(300)] + ["a w1 a", "w1 a w2", "a", "w2 a"]
    keywords = spark.createDataFrame([(f"K{i}", p) for i, p in enumerate(phrases + ["a w1"])], "kwid string, text string")
    words = ["a", "w1", "a", "w2", "a", "w3"] * 5
    ctm = spark.createDataFrame([(u, i + 1, i * 0.4, 0.4, w) for u in ("u1", "u2") for i, w in enumerate(words)], "utt string, pos int, start double, dur double, word string")
    want = sorted((f"K{n}", u) for u in ("u1", "u2") for n, p in enumerate(phrases + ["a w1"]) for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    before = len(helpers._scratched)
    index.build_index(ctm, str(tmp_path / "i"))
    assert rows(lexical.keyword_search(ctm, keywords, 0.1), "kwid", "utt") == want
    for few in (1000, 0):
        assert rows(index.search_index(spark, str(tmp_path / "i"), keywords, 0.1, few), "kwid", "utt") == want
    stored = [p for p in helpers._scratched[before:] if "-hits-" in p]
    assert stored and all(spark.read.parquet(p).count() <= 4 * len(words) for p in stored)  # not a row for each keyword


def test_character_maps_leave_in_batches_of_bounded_size(spark, monkeypatch):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(["<p>abc", None, "", "x" * 500, "y&amp;z", "w" * 90])], "page_id long, html string").coalesce(1)
    caught = {}
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: caught.update(run=run))
    text.html_to_text(pages, "page_id", "html", True, 100)
    html = [r[1] for r in pages.collect()]
    out = list(caught["run"](iter([pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(html)], ["id", "html"])])))
    assert [b.num_rows for b in out] == [4, 2]
    got = [r for b in out for r in b.to_pylist()]
    for i, (r, h) in enumerate(zip(got, html)):
        want, places = text.html_with_map(h or "")
        assert (r["id"], r["text"], [(p["page"], p["text"]) for p in r["places"]]) == (i, want, places)


def test_a_keyword_of_many_hits_is_several_elements(spark, tmp_path):
    hits = [("K1", f"f{i % 7}", "1", i * 0.5, 0.5, (i * 37 % 100) / 100, "YES") for i in range(250)] + [("K2", "f", None, 1.0, 0.5, 0.5, "NO")]
    df = spark.createDataFrame(hits, "kwid string, file string, channel string, tbeg double, dur double, score double, decision string")
    tables.write_kwslist(df, str(tmp_path / "kws"), 40)
    assert rows(tables.read_kwslist(spark, str(tmp_path / "kws")), *df.columns) == sorted(hits, key=str)
    elements = spark.read.format("xml").option("rowTag", "detected_kwlist").schema("_kwid string, kw array<struct<_score:double>>").load(str(tmp_path / "kws")).collect()
    assert max(len(e["kw"]) for e in elements) <= 40
    for e in elements:
        scores = [h["_score"] for h in e["kw"]]
        assert scores == sorted(scores, reverse=True)


def plain_smooth(segments, models, window, factor, least):
    scores, out, turn = [list(s[2]) for s in segments], set(), 0
    while True:
        turn += 1
        label, total = [], {m: 0 for m in models if m not in out}
        for i, (start, end, _) in enumerate(segments):
            mean, time = [0.0] * len(models), 0
            for j in range(i - 1, 0, -1):
                if segments[j][1] <= start - window:
                    break
                w = segments[j][1] - max(segments[j][0], start - window)
                time += w
                mean = [m + w * v for m, v in zip(mean, scores[j])]
            for j in range(i + 1, len(segments)):
                if segments[j][0] >= end + window:
                    break
                w = min(segments[j][1], end + window) - segments[j][0]
                time += w
                mean = [m + w * v for m, v in zip(mean, scores[j])]
            if time > 0:
                scores[i] = [v + factor * m / time for v, m in zip(scores[i], mean)]
            use = [k for k, m in enumerate(models) if m not in out]
            label.append(models[max(use, key=lambda k: (scores[i][k], -k))] if use else None)
            if use:
                total[label[-1]] += end - start
        poor = {m for m, t in total.items() if t < least}
        if not least or not poor:
            return label, turn
        out |= poor


@pytest.mark.parametrize("least", [0, 900, 10**9])
def test_labels_settle_as_in_a_plain_loop(spark, least):
    rng, models, data, want = random.Random(least), ["m0", "m1", "m2", "m3"], [], {}
    for rec in range(6):
        at, segments = 0, []
        for _ in range(25):
            at += rng.randint(0, 700)
            end = at + rng.randint(10, 300)
            segments.append((at, end, [round(-rng.random() * 10, 2) for _ in models]))
            at = end
        label, turns = plain_smooth(segments, models, 500, 0.5, least)
        want |= {(f"r{rec}", rec * 100 + i): (x, turns) for i, x in enumerate(label)}
        data += [(f"r{rec}", rec * 100 + i, s, e, m, v) for i, (s, e, x) in enumerate(segments) for m, v in zip(models, x)]
    df = spark.createDataFrame(data, "rec string, event_id long, start_cs long, end_cs long, model string, score double")
    got = {(r["rec"], r["event_id"]): (r["label"], r["rounds"]) for r in recordings.smooth_and_discard(df, 500, 0.5, least).collect()}
    assert got == want


# --- streams

BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def arrivals(spark, path, batches, schema):
    """One file a batch, in order; a stream over them, one file a micro-batch."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(minutes):
    return BEGIN + dt.timedelta(minutes=minutes)


def test_status_machine_sorts_arrivals_and_refuses_illegal_events(spark, tmp_path):
    schema = "jobid string, event_id long, status string, at timestamp"
    first = [("j", 3, "C", at(3)), ("j", 1, "P", at(1)), ("k", 10, "R", at(1)), ("j", 5, "N", at(5))]
    second = [("j", 2, "D", at(2)), ("j", 4, "Q", at(4)), ("k", 11, "P", at(6)), ("k", 12, "E", at(7))]  # late, but within ten minutes
    third = [("z", 20, "P", at(60)), ("k", 13, "P", at(8))]
    fourth = [("j", 6, "R", at(6)), ("z", 21, "X", at(100))]  # the watermark has passed 6: dropped
    stream = arrivals(spark, str(tmp_path / "in"), [first, second, third, fourth], schema).withWatermark("at", "10 minutes")
    got = rows(stateful.run_stateful(stateful.status_log(stream)), "jobid", "event_id", "before", "status", "legal")
    assert got == sorted([
        ("j", 1, None, "P", True), ("j", 2, "P", "D", True), ("j", 3, "D", "C", True), ("j", 4, "C", "Q", True), ("j", 5, "Q", "N", False),
        ("k", 10, None, "R", False), ("k", 11, None, "P", True), ("k", 12, "P", "E", True), ("k", 13, "E", "P", True), ("z", 20, None, "P", True),
    ], key=str)


def test_tokens_expire_once_the_watermark_passes(spark, tmp_path):
    schema = "user long, token long, at timestamp, expiry timestamp"
    batches = [[(1, 7, at(0), at(30)), (1, 8, at(1), at(500))], [(2, 9, at(45), at(50))], [(2, 10, at(90), at(200))]]
    stream = arrivals(spark, str(tmp_path / "in"), batches, schema).withWatermark("at", "10 minutes")
    assert rows(stateful.run_stateful(stateful.token_log(stream)), "user", "token", "action") == sorted(
        [(1, 7, "issued"), (1, 8, "issued"), (2, 9, "issued"), (2, 10, "issued"), (1, 7, "expired"), (2, 9, "expired")], key=str
    )


def test_late_rows_are_counted_batch_by_batch(spark, tmp_path):
    schema = "event_id long, at timestamp"
    batches = [[(1, at(0)), (2, at(60))], [(3, at(55)), (4, at(20)), (5, at(10)), (6, at(61))], [(7, at(49))]]
    arrivals(spark, str(tmp_path / "in"), batches, schema)
    got = stateful.late_rows(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "10 minutes")
    assert rows(got, "batch", "n_rows", "n_late") == [(0, 2, 0), (1, 4, 2), (2, 1, 1)]


# --- a stored index

@pytest.mark.parametrize("block", [3, 4096])
def test_index_finds_what_a_scan_finds(spark, tmp_path, block):
    """Words in blocks of three, so that hot words have many and most are skipped; phrases of one to four words."""
    from parlance.operators import index, lexical

    rng = random.Random(9)
    data = []
    for u in range(40):
        at = 0.0
        for pos in range(rng.randint(0, 25)):
            dur = rng.choice([0.2, 0.3])
            data.append((f"u{u:02d}", pos + 1, round(at, 2), dur, rng.choice("aaaaabbbc")))
            at += dur + rng.choice([0.0, 0.1, 0.9])
    ctm = spark.createDataFrame(data, "utt string, pos int, start double, dur double, word string")
    phrases = ["a", "c", "a b", "b c", "c a a", "b a a b", "a z", "z"]
    keywords = spark.createDataFrame([(f"K{i}", p) for i, p in enumerate(phrases)], "kwid string, text string")
    index.build_index(ctm, str(tmp_path / "i"), block)
    stored = spark.read.parquet(str(tmp_path / "i" / "blocks"))
    assert stored.agg(F.sum("n"), F.max("n")).first()[0] == len(data) and stored.agg(F.max("n")).first()[0] <= block
    got = index.search_index(spark, str(tmp_path / "i"), keywords, 0.1)
    want = lexical.keyword_search(ctm, keywords, 0.1)
    cols = ["kwid", "utt", F.round("tbeg", 2).alias("t"), "dur"]
    assert rows(got, *cols) == rows(want, *cols) and len({r["kwid"] for r in got.collect()}) >= 5
    assert index.search_index(spark, str(tmp_path / "i"), keywords.limit(0)).count() == 0


def test_index_search_reads_the_words_it_needs(spark, tmp_path):
    from parlance.operators import index

    ctm = spark.createDataFrame([("u", i + 1, i * 1.0, 0.5, f"w{i}") for i in range(30)], "utt string, pos int, start double, dur double, word string")
    index.build_index(ctm, str(tmp_path / "i"))
    plan = index.blocks_of(spark, str(tmp_path / "i"), spark.createDataFrame([("w7",)], "word string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "w7" in plan.split("PushedFilters")[1]


# --- merge join

def test_merge_join_equals_every_pair(spark):
    rng = random.Random(2)
    words = [(r, s, s + rng.randint(1, 400), f"w{i}") for i in range(60) for r in ("r", "q") for s in [rng.randint(0, 900)]]
    phones = [(r, rng.randint(0, 1200), f"p{i}") for i in range(60) for r in ("r", "q", "none")]
    from parlance.operators import joins

    got = joins.phones_in_words_swept(spark.createDataFrame(words, "rec string, start long, end long, word string"), spark.createDataFrame(phones, "rec string, mid long, phone string"))
    want = sorted((r, m, p, w) for r, m, p in phones for q, s, e, w in words if r == q and s < m < e)
    assert sorted(tuple(x) for x in got.select("rec", "mid", "phone", "word").collect()) == want


# --- stored tables

def test_released_tables_are_gone(spark):
    import os

    from parlance.operators import helpers

    kept = helpers.store(spark.range(3), "kept")
    mark = len(helpers._scratched)
    gone = helpers.store(spark.range(3), "gone")
    path = gone.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and helpers.release(spark, mark) == mark
    assert not os.path.exists(path) and kept.count() == 3


def test_table_functions_refuse_wrong_arguments(spark):
    from parlance.functions import generators

    generators.register(spark)
    spark.createDataFrame([("r", 95)], "rec string, dur long").createOrReplaceTempView("durations")
    assert [tuple(r) for r in spark.sql("SELECT * FROM equal_chunks(TABLE(durations), 2) ORDER BY k").collect()] == [("r", 0, 0, 47), ("r", 1, 47, 95)]
    with pytest.raises(Exception, match="positive whole number"):
        spark.sql("SELECT * FROM equal_chunks(TABLE(durations), 0)").collect()
    with pytest.raises(Exception, match="a column at"):
        spark.sql("SELECT * FROM min_gap(TABLE(durations), 1D)").collect()


# --- word errors by the full table of distances

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_corpus_and_oracle_errors_equal_the_full_table(spark):
    from parlance.operators import scoring

    rng = random.Random(4)
    refs = {f"u{i}": [rng.choice("abcd") for _ in range(rng.randint(0, 30))] for i in range(25)}
    hyps = {(u, h): [w for w in r if rng.random() > 0.2] + [rng.choice("abcde") for _ in range(rng.randint(0, 4))] for u, r in refs.items() for h in ("x", "y", "z")}
    ref = spark.createDataFrame(list(refs.items()), "utt string, words array<string>")
    nbest = spark.createDataFrame([(u, h, w) for (u, h), w in hyps.items()], "utt string, hyp string, words array<string>")
    got = {r["utt"]: r["err"] for r in scoring.oracle_error(nbest, ref).collect()}
    assert got == {u: min(distance(r, hyps[u, h]) for h in "xyz") for u, r in refs.items()}
    total = scoring.corpus_wer(ref, nbest.filter("hyp = 'x'").select("utt", "words")).first()
    assert total["err"] == sum(distance(r, hyps[u, "x"]) for u, r in refs.items()) and total["n_word"] == sum(map(len, refs.values()))


def test_ordered_streams_carry_their_state(spark, tmp_path):
    """Three micro-batches, the rows of each out of order; a user that one batch lacks keeps its state."""
    schema = "event_id long, user_id long, value double, at timestamp"
    batches = [[(2, 1, 4.0, at(2)), (1, 1, 2.0, at(1)), (9, 2, 1.0, at(1))], [(10, 2, 3.0, at(5))], [(4, 1, 9.0, at(9)), (3, 1, 1.0, at(8)), (11, 2, 5.0, at(5.01))]]
    stream = arrivals(spark, str(tmp_path / "in"), batches, schema)
    got = rows(streams.running_mean(stream), "event_id", "user_id", "n", "total", "centred")
    assert got == sorted([(1, 1, 1, 2.0, 0.0), (2, 1, 2, 6.0, 1.0), (3, 1, 3, 7.0, 1.0 - 7 / 3), (4, 1, 4, 16.0, 5.0), (9, 2, 1, 1.0, 0.0), (10, 2, 2, 4.0, 1.0), (11, 2, 3, 9.0, 2.0)], key=str)
    assert {r[0] for r in rows(streams.dedup_hits(stream, 61.0), "event_id")} == {1, 3, 9, 10}


def test_large_lookups_shuffle_distinct_tokens_of_a_block(spark, monkeypatch):
    """Texts that repeat their tokens are looked up without a row a token, in any number of blocks."""
    monkeypatch.setattr(maps, "BLOCK", 3)
    monkeypatch.setattr(maps, "LONG", 50)
    words = [[f"w{(i * j) % 5}" for j in range(i * 7)] for i in range(10)]
    df = spark.createDataFrame(list(enumerate(words)), "k long, words array<string>").coalesce(2)
    table = spark.createDataFrame([(f"w{i}", i + 3) for i in range(5)], "sym string, id int")
    ids = maps.symbols_to_ids(df, table, "k", "words", in_place=-1)
    assert "posexplode" not in ids._jdf.queryExecution().toString().lower()
    assert {r["k"]: r["ids"] for r in ids.collect()} == {i: [int(x[1:]) + 3 for x in w] for i, w in enumerate(words) if w}
    back = maps.ids_to_symbols(ids.select("k", "ids"), table, "k", "ids", in_place=-1)
    assert {r["k"]: r["words"] for r in back.collect()} == {i: w for i, w in enumerate(words) if w}
    none = maps.map_tokens(df, spark.createDataFrame([], "sym string, values array<string>"), "k", "words", permissive=True)
    assert {r["k"]: r["words"] for r in none.collect()} == dict(enumerate(words))


def test_a_user_of_many_tokens_waits_for_one_expiry():
    from types import SimpleNamespace

    import pandas as pd

    state, timers = [], []
    kept = SimpleNamespace(appendList=state.extend, get=lambda: iter(list(state)), clear=state.clear, put=state.extend)
    store = stateful.TokenStore()
    store.init(SimpleNamespace(getListState=lambda *_: kept, registerTimer=timers.append))
    list(store.handleInputRows((1,), iter([pd.DataFrame({"token": range(50), "expiry_us": [k * 1000 for k in range(50)]})]), None))
    assert timers == [1]  # before, one timer and one call to the state a token
    dead = list(store.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 30), None))
    assert [x["token"].tolist() for x in dead] == [list(range(30))] and timers == [1, 31] and len(state) == 20
    assert list(store.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 30), None)) == []


def test_jobs_of_a_lot_share_calls_to_the_state(monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    monkeypatch.setattr(stateful, "ENTRY", 7, raising=False)
    entries, statuses, timers, calls = [], {}, [], []
    kept = SimpleNamespace(appendList=lambda x: (calls.append(len(x)), entries.extend(x)), get=lambda: iter(list(entries)), clear=entries.clear, put=entries.extend)
    status = SimpleNamespace(getValue=statuses.get, updateValue=statuses.__setitem__)
    machine = stateful.StatusMachine(stateful.FLOW, "P")
    machine.init(SimpleNamespace(getListState=lambda *_: kept, getMapState=lambda *_: status, getValueState=lambda *_: None, registerTimer=timers.append))
    frame = pd.DataFrame([(f"j{j}", (10 * i + j) * 1000, str(100 * i + j), "PDC"[i]) for i in range(3) for j in range(10)], columns=["jobid", "us", "event_id", "status"])
    list(machine.handleInputRows((0,), iter([frame]), None))
    assert timers == [1] and calls == [1]  # before, a timer an event, and a call to the state and a frame a job
    due = list(machine.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 15), None))
    assert len(due) == 1 and sorted(due[0]["event_id"]) == [*range(10), *range(100, 105)] and due[0]["legal"].all()
    assert timers == [1, 16] and [len(x[0]) for x in entries] == [7, 7, 1] and statuses[("j4",)] == ("D",) and statuses[("j5",)] == ("P",)
    assert list(machine.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 15), None)) == [] and len(entries) == 3
    rest = list(machine.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1000), None))
    assert len(rest[0]) == 15 and rest[0]["legal"].all() and entries == [] and timers == [1, 16] and set(statuses.values()) == {("C",)}


def test_status_machine_equals_a_plain_loop_over_shared_lots(spark, tmp_path, monkeypatch):
    """Jobs of one lot do not mix; null ids and statuses, rows that come twice, and the last millisecond before the watermark."""
    monkeypatch.setattr(stateful, "LOTS", 3, raising=False)
    draw = random.Random(5)
    jobs, letters = [None, *(f"j{k}" for k in range(9))], [None, *"PPPDDCQRNEUWXZ"]
    batches = [[(draw.choice(jobs), 100 * b + i, draw.choice(letters), at(9 * b + draw.randrange(9))) for i in range(60)] for b in range(3)]
    big = 2**53 + 1  # no float holds it
    batches[1] += [batches[1][0], ("j1", None, "P", at(10)), (None, big, None, at(11)), ("j2", 7, "P", None)]
    ms = dt.timedelta(milliseconds=1)
    batches[2] += [("m", 900, "P", at(50) - ms), ("m", 901, "D", at(50)), ("n", 902, "P", at(60))]  # the watermark ends at 50
    expected, now = [], {}
    for job, event, status, _ in sorted((r for b in batches for r in b if r[3] and r[3] < at(50)), key=lambda r: (r[3], r[1] is None, r[1] or 0)):
        before = now.get(job)
        legal = status == "P" if before is None else status is not None and status in stateful.FLOW[before]
        expected.append((job, event, before, status, legal))
        if legal:
            now[job] = status
    stream = arrivals(spark, str(tmp_path / "in"), batches, "jobid string, event_id long, status string, at timestamp").withWatermark("at", "10 minutes")
    got = rows(stateful.run_stateful(stateful.status_log(stream)), "jobid", "event_id", "before", "status", "legal")
    assert got == sorted(expected, key=str) and ("m", 900, None, "P", True) in got
