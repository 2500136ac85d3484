"""Joins of corpus tables: chained lookups, time containment, nearest points, completeness checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .helpers import ordered_list, range_join, small


def ctm_to_recording(ctm: DataFrame, segments: DataFrame, reco2file: DataFrame, skip_unknown: bool = True) -> DataFrame:
    """Words of utterances in the time and under the name of their recording's file.

    Words that pass the segment's end by over 0.01 s are flagged. An utterance without a segment is skipped, or an
    error; a recording without a file is always an error.
    """
    seg = small(segments.select("utt", "rec", F.col("start").alias("seg_start"), F.col("end").alias("seg_end")))
    out = ctm.join(seg, "utt", "inner" if skip_unknown else "left")
    if not skip_unknown:
        out = out.withColumn("rec", F.coalesce("rec", F.raise_error(F.concat(F.lit("no segment for "), "utt")).cast("string")))
    names = small(reco2file.select("rec", "file", F.col("channel").alias("file_channel")))
    out = out.join(names, "rec", "left").withColumn("file", F.coalesce("file", F.raise_error(F.concat(F.lit("no file for "), "rec")).cast("string")))
    start = F.round(F.col("seg_start") + F.col("start"), 2)
    return out.select("utt", "file", F.col("file_channel").alias("channel"), start.alias("start"), "dur", "word", "conf", (start + F.col("dur") > F.col("seg_end") + 0.01).alias("past_end"))


def words_in_segments(words: DataFrame, segments: DataFrame, width: float = 3.0) -> DataFrame:
    """For each segment (rec, seg, start, end) the words (rec, start, dur, word) that lie wholly inside it, in time order."""
    w = words.select("rec", F.col("start").alias("w_start"), F.round(F.col("start") + F.col("dur"), 2).alias("w_end"), "word")
    hit = range_join(w, segments.select("rec", "seg", "start", "end"), ["rec"], "w_start", "start", "end", width)
    hit = hit.filter("w_start >= start and w_end <= end")
    return hit.groupBy("rec", "seg").agg(F.array_join(ordered_list(["w_start", "w_end", "word"], "word"), " ").alias("text"), F.count("*").alias("n_words"))


def phones_in_words(words: DataFrame, phones: DataFrame, width: int = 300) -> DataFrame:
    """Phones (rec, mid, phone) whose midpoint lies strictly inside a word (rec, start, end, word), in centiseconds."""
    hit = range_join(phones, words, ["rec"], "mid", "start", "end", width)
    return hit.filter("mid > start and mid < end")


def phones_in_words_swept(words: DataFrame, phones: DataFrame) -> DataFrame:
    """As :func:`phones_in_words`, by a merge of both tables in time order: one pass, no row copied.

    Words and phones of a recording are laid in one sequence, and the words that have begun and not ended are held
    in a heap by their end. Where words are long or many overlap this saves the copies by bucket; a recording is one
    stream of rows, so the bucket join is the better one where a single recording holds much of all rows.
    """
    from heapq import heappop, heappush

    from .streamed import in_order

    none = F.lit(None)
    begins = words.select("rec", F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), F.col("end").cast("long").alias("end"), "word", none.cast("string").alias("phone"))
    points = phones.select("rec", F.col("mid").cast("long").alias("at"), F.lit(0).alias("kind"), none.cast("long").alias("end"), none.cast("string").alias("word"), "phone")

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        begun: list[tuple] = []
        for number, (rec, at, kind, end, word, phone) in enumerate(rows):
            if kind:
                heappush(begun, (end, number, at, word))
                continue
            while begun and begun[0][0] <= at:
                heappop(begun)
            for end, _, start, word in begun:
                yield (rec, at, phone, start, end, word)

    # at one time points come first: a word holds what lies strictly inside it
    return in_order(points.unionByName(begins), ["rec"], ["at", "kind"], walk, "rec string, mid long, phone string, start long, end long, word string")


def nearest_points(targets: DataFrame, points: DataFrame, on: str) -> DataFrame:
    """Each target (id, at) snapped to the nearest point (at) of its group; zero is a point; a tie keeps the earlier.

    Targets and points are laid in one time order, and each target looks at the last point before and the first
    point after it: a pair of windows, with no product of the two tables.
    """
    from pyspark.sql import Window

    zero = targets.select(on).distinct().withColumn("at", F.lit(0.0))
    both = targets.select(on, "id", "at", F.lit(None).cast("double").alias("point")).unionByName(
        points.select(on, "at").unionByName(zero).distinct().select(on, F.lit(None).cast("long").alias("id"), "at", F.col("at").alias("point"))
    )
    w = Window.partitionBy(on).orderBy("at", F.col("id").isNotNull())
    back = Window.partitionBy(on).orderBy(F.desc("at"), F.col("id").isNotNull())
    both = both.withColumn("before", F.last("point", True).over(w)).withColumn("after", F.last("point", True).over(back)).filter("id is not null")
    pick = F.when(F.col("after").isNull() | (F.col("at") - F.col("before") <= F.col("after") - F.col("at")), F.col("before")).otherwise(F.coalesce("after", "before"))
    return both.select(on, "id", "at", pick.alias("nearest"))


def segment_words(segments: DataFrame, ctm: DataFrame) -> DataFrame:
    """Words at absolute times: the segment's start, to two decimals, and the word's own."""
    s = segments.select("utt", "rec", F.round("start", 2).alias("seg_start"))
    return ctm.join(s, "utt").select("utt", "rec", F.round(F.col("seg_start") + F.col("start"), 2).alias("start"), "dur", "word", "conf")


def fill_missing(ctm: DataFrame, expected: DataFrame, token: str = "EMPTY_RECOGNIZED_PHRASE") -> DataFrame:
    """Add a placeholder row for every expected utterance that has no words; an unexpected utterance is an error."""
    gone = expected.select("utt").distinct().join(ctm.select("utt").distinct(), "utt", "left_anti")
    rows = gone.select("utt", F.lit("1").alias("channel"), F.lit(0.0).alias("start"), F.lit(0.0).alias("dur"), F.lit(token).alias("word"))
    known = expected.select("utt").distinct().withColumn("_ok", F.lit(True))
    mine = ctm.select("utt", "channel", "start", "dur", "word").join(known, "utt", "left")
    mine = mine.withColumn("word", F.when(F.col("_ok"), F.col("word")).otherwise(F.raise_error(F.concat(F.lit("unexpected utterance "), "utt")).cast("string"))).drop("_ok")
    return mine.unionByName(rows)


def by_file_channel(ctm: DataFrame, reco2file: DataFrame) -> DataFrame:
    """Recording of each row by file and channel; a missing pair is an error."""
    out = ctm.join(small(reco2file.select("file", "channel", "rec")), ["file", "channel"], "left")
    return out.withColumn("rec", F.coalesce("rec", F.raise_error(F.concat(F.lit("no recording for "), "file")).cast("string")))


def speakers_of_segments(old: DataFrame, utt2spk: DataFrame, new: DataFrame) -> DataFrame:
    """Speaker of each new segment through its recording's old segments; two speakers in a recording are an error."""
    by_rec = old.join(utt2spk, "utt").groupBy("rec").agg(F.min("spk").alias("spk"), F.max("spk").alias("other"))
    one = F.when(F.col("spk") == F.col("other"), F.col("spk")).otherwise(F.raise_error(F.concat(F.lit("several speakers in "), "rec")).cast("string"))
    return new.join(by_rec.select("rec", one.alias("spk")), "rec").select("utt", "spk")


def attach(df: DataFrame, other: DataFrame, on: str, value: str, strict: bool = False) -> DataFrame:
    """Left join of one value; a missing one is null, or an error with ``strict``."""
    out = df.join(other.select(on, value), on, "left")
    if strict:
        out = out.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("nothing for "), on)).cast(dict(out.dtypes)[value])))
    return out


def paste_features(a: DataFrame, b: DataFrame, tolerance: int = 0) -> DataFrame:
    """Feature rows (utt, frame, vec) side by side, cut to the shorter; lengths may differ by ``tolerance`` frames."""
    n = a.groupBy("utt").agg(F.count("*").alias("na")).join(b.groupBy("utt").agg(F.count("*").alias("nb")), "utt")
    fine = n.filter(F.abs(F.col("na") - F.col("nb")) <= tolerance).select("utt")
    both = a.select("utt", "frame", F.col("vec").alias("va")).join(b.select("utt", "frame", F.col("vec").alias("vb")), ["utt", "frame"])
    return both.join(fine, "utt", "left_semi").select("utt", "frame", F.concat("va", "vb").alias("vec"))


def pair_by_id(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join of two tables that should have the same ids, with the side that lacks one."""
    out = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full")
    return out.withColumn("missing", F.when(F.col("_l").isNull(), "left").when(F.col("_r").isNull(), "right")).drop("_l", "_r")


def service_catalog(services: DataFrame, require: DataFrame, subsystems: DataFrame) -> DataFrame:
    """Services with what they require and their subsystems in order."""
    subs = subsystems.groupBy("service").agg(F.array_join(F.array_sort(F.collect_set("subsystem")), ",").alias("subsystems"))
    return services.join(require, "name", "left").join(subs, F.col("name") == F.col("service"), "left").drop("service")


def validate_requests(requests: DataFrame, services: DataFrame, require: DataFrame, subsystems: DataFrame) -> DataFrame:
    """First reason to reject each request: service, audio, text, subsystem; null if it is accepted."""
    r = requests.join(services.select(F.col("name").alias("service"), F.lit(True).alias("_s")), "service", "left")
    r = r.join(require.select(F.col("name").alias("service"), F.col("audio").alias("need_audio"), F.col("text").alias("need_text")), "service", "left")
    r = r.join(subsystems.select("service", "subsystem", F.lit(True).alias("_u")), ["service", "subsystem"], "left")
    reason = (
        F.when(F.col("_s").isNull(), "unknown service")
        .when((F.col("need_audio") == "Y") & F.col("getaudio").isNull(), "no audio")
        .when((F.col("need_text") == "Y") & F.col("gettext").isNull(), "no text")
        .when(F.col("_u").isNull(), "unknown subsystem")
    )
    return r.withColumn("reject_reason", reason).drop("_s", "_u", "need_audio", "need_text")


def score_candidates(cands: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``right`` if the pronunciation is the word's, ``partial`` if it is but for stress digits, else ``wrong``."""
    exact = lexicon.select("word", "pron", F.lit(True).alias("_e")).distinct()
    bare = lexicon.select("word", F.regexp_replace("pron", "[0-9]", "").alias("_bare"), F.lit(True).alias("_b")).distinct()
    out = cands.join(exact, ["word", "pron"], "left").withColumn("_bare", F.regexp_replace("pron", "[0-9]", "")).join(bare, ["word", "_bare"], "left")
    return out.withColumn("grade", F.when(F.col("_e"), "right").when(F.col("_b"), "partial").otherwise("wrong")).drop("_e", "_b", "_bare")


def lexicon_lookup(words: DataFrame, lexicon: DataFrame, fallback: DataFrame, lang: str) -> DataFrame:
    """Pronunciation by dictionary, then by the language's fallback table, then ``<unk>``; keys end before a ``<``."""
    w = words.withColumn("_k", F.split("word", "<")[0])
    d = lexicon.select(F.col("word").alias("_k"), F.col("pron").alias("_d"))
    f = fallback.select(F.col("word").alias("_f"), F.col("pron").alias("_p"))
    out = w.join(d, "_k", "left").join(f, F.concat(F.lit(f"{lang}:"), "_k") == F.col("_f"), "left")
    return out.withColumn("pron", F.coalesce("_d", "_p", F.lit("<unk>"))).drop("_k", "_d", "_f", "_p")


def unique_closure(utts: DataFrame, utt2uniq: DataFrame) -> DataFrame:
    """Chosen utterances, their originals, and every copy of those."""
    origin = utt2uniq.join(utts.select("utt"), "utt", "left_semi").select("uniq").distinct()
    return utt2uniq.join(origin, "uniq", "left_semi").select("utt", "uniq")


