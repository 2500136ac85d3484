"""Upkeep of corpora: a corpus is a dict of tables that must agree on utterances, speakers and recordings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .helpers import seeded, store
from .streamed import in_order

c = F.col
#: Key of each table of a corpus.
KEYS = {"utt2spk": "utt", "text": "utt", "segments": "utt", "feats": "utt", "utt2lang": "utt", "wav": "rec", "reco2file": "rec", "spk2gender": "spk", "cmvn": "spk"}


def combine(*corpora: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Union of corpora, table by table; a table that the first lacks is left out, and one that a later lacks too."""
    return {k: reduce(DataFrame.unionByName, [d[k] for d in corpora]) for k in corpora[0] if all(k in d for d in corpora)}


def subset(corpus: dict[str, DataFrame], utts: DataFrame | None = None, speakers: DataFrame | None = None) -> dict[str, DataFrame]:
    """The corpus of chosen utterances (utt) or speakers (spk): every table is semi-joined to what survives."""
    u = corpus["utt2spk"]
    u = u.join(utts.select("utt"), "utt", "left_semi") if utts is not None else u.join(speakers.select("spk"), "spk", "left_semi")
    keep = {"utt": u.select("utt"), "spk": u.select("spk")}
    if "segments" in corpus:
        keep["rec"] = corpus["segments"].join(keep["utt"], "utt", "left_semi").select("rec")
    return {k: t.join(keep[KEYS[k]], KEYS[k], "left_semi") if KEYS[k] in keep else t for k, t in corpus.items()}


def fix(corpus: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Drop whatever lacks a counterpart: recordings, then utterances of every table, then speakers, then recordings again."""
    t = dict(corpus)
    if "segments" in t:
        for k in ("wav", "reco2file"):
            if k in t:
                t["segments"] = t["segments"].join(t[k].select("rec"), "rec", "left_semi")
    by_utt = [k for k in t if KEYS[k] == "utt"]
    utts = reduce(lambda a, b: a.intersect(b), [t[k].select("utt") for k in by_utt])
    for k in [k for k in t if KEYS[k] == "spk"]:
        utts = utts.intersect(t["utt2spk"].join(t[k].select("spk"), "spk", "left_semi").select("utt"))
    return subset(t, utts=utts)


def validate(corpus: dict[str, DataFrame]) -> DataFrame:
    """Violations (check, key): repeated keys, missing counterparts, bad times, channels and reserved symbols."""
    out = []
    for k, t in corpus.items():
        out.append(t.groupBy(c(KEYS[k]).alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"{k}: repeated").alias("check"), "key"))
        if KEYS[k] == "utt" and k != "utt2spk":
            out.append(t.join(corpus["utt2spk"], "utt", "left_anti").select(F.lit(f"{k}: no speaker").alias("check"), c("utt").alias("key")))
            out.append(corpus["utt2spk"].join(t, "utt", "left_anti").select(F.lit(f"{k}: missing").alias("check"), c("utt").alias("key")))
        if KEYS[k] == "spk":
            out.append(corpus["utt2spk"].select("spk").distinct().join(t, "spk", "left_anti").select(F.lit(f"{k}: missing").alias("check"), c("spk").alias("key")))
    if "segments" in corpus:
        s = corpus["segments"]
        out.append(s.filter("not (end > start or end = -1)").select(F.lit("segments: times").alias("check"), c("utt").alias("key")))
    if "text" in corpus:
        bad = F.exists("words", lambda w: w.isin("<s>", "</s>", "#0"))
        out.append(corpus["text"].filter(bad).select(F.lit("text: reserved symbol").alias("check"), c("utt").alias("key")))
    if "reco2file" in corpus:
        out.append(corpus["reco2file"].filter("channel not in ('A', 'B')").select(F.lit("reco2file: channel").alias("check"), c("rec").alias("key")))
    return reduce(DataFrame.unionByName, out)


def validate_lines(corpus: dict[str, DataFrame]) -> DataFrame:
    """Violations (check, key) that need a table's lines or its other columns, beside those of :func:`validate`.

    A table with ``pos`` (line numbers without gaps) must be sorted by its key, and ``utt2spk`` by speaker too. Genders are m or f,
    warp factors lie between 0.5 and 1.5, tables by speaker hold no speaker that ``utt2spk`` lacks, and
    ``spk2utt`` (spk, utts) holds the same pairs as ``utt2spk``. A line meets the one before it by an equi-join on
    their numbers, so nothing is sorted.
    """
    out = []

    def told(rows: DataFrame, check: str, key: str) -> None:
        out.append(rows.select(F.lit(check).alias("check"), c(key).alias("key")))

    for name, t in corpus.items():
        key = KEYS.get(name) or {"spk2utt": "spk", "spk2warp": "spk", "utt2warp": "utt"}[name]
        if "pos" in t.columns:
            orders = [key, "spk"] if name == "utt2spk" else [key]
            ahead = t.select((c("pos") + 1).alias("pos"), *[c(x).alias(f"_{x}") for x in orders])
            for x in orders:
                told(t.join(ahead, "pos").filter(c(x) < c(f"_{x}")), f"{name}: not sorted by {x}", key)
        if key == "spk" and "utt2spk" in corpus:
            told(t.join(corpus["utt2spk"], "spk", "left_anti"), f"{name}: no such speaker", "spk")
        if name == "spk2gender":
            told(t.filter(~F.coalesce(c("gender").isin("m", "f"), F.lit(False))), "spk2gender: gender", "spk")
        if name in ("spk2warp", "utt2warp"):
            told(t.filter(~F.coalesce((c("warp") > 0.5) & (c("warp") < 1.5), F.lit(False))), f"{name}: warp factor", key)
    if "spk2utt" in corpus and "utt2spk" in corpus:
        pairs, other = corpus["spk2utt"].select("spk", F.explode("utts").alias("utt")), corpus["utt2spk"].select("spk", "utt")
        told(pairs.join(other, ["spk", "utt"], "left_anti"), "spk2utt: not in utt2spk", "utt")
        told(other.join(pairs, ["spk", "utt"], "left_anti"), "spk2utt: missing", "utt")
    return reduce(DataFrame.unionByName, out)


def validate_lexicon_pair(lexicon: DataFrame, weighted: DataFrame, phones: DataFrame) -> DataFrame:
    """Violations (check, key) between a lexicon (word, phones) and its weighted form, and of phone names (phone).

    Entries are compared with their repeats. Weights (all columns of ``weighted`` but word and phones) must be above 0,
    the pronunciation's (``prob``) at most 1. A phone must not end in ``_`` or in a mark of its place in the word
    (``_B``, ``_E``, ``_S``, ``_I``), nor hold ``#``.
    """
    count = F.count("*")
    a = lexicon.groupBy("word", "phones").agg(count.alias("n"))
    b = weighted.groupBy("word", "phones").agg(count.alias("m"))
    both = a.join(b, ["word", "phones"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    weights = [x for x in weighted.columns if x not in ("word", "phones")]
    bad = reduce(lambda x, y: x | y, [~F.coalesce((c(w) > 0) & ((c(w) <= 1) if w == "prob" else F.lit(True)), F.lit(False)) for w in weights], F.lit(False))
    parts = [
        both.filter(n > m).select(F.lit("not weighted").alias("check"), c("word").alias("key")),
        both.filter(n < m).select(F.lit("only weighted").alias("check"), c("word").alias("key")),
        weighted.filter(bad).select(F.lit("weight").alias("check"), c("word").alias("key")),
        phones.filter(c("phone").rlike("_$|#|_[BESI]$")).select(F.lit("phone name").alias("check"), c("phone").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts)


def validate_lexicon(lexicon: DataFrame, silence: DataFrame, nonsilence: DataFrame) -> DataFrame:
    """Violations (check, key) of a lexicon (word, phones, prob) and its phone sets (phone).

    The lexicon is written once, as each check reads it.
    """
    lexicon = store(lexicon, "lexicon")
    p = F.array_join("phones", " ")
    flat = lexicon.select("word", F.explode("phones").alias("phone"))
    known = silence.select("phone").unionByName(nonsilence.select("phone")).distinct()
    parts = [
        lexicon.groupBy("word", p.alias("p")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated entry").alias("check"), c("word").alias("key")),
        lexicon.filter(c("word").isin("<s>", "</s>", "<eps>", "#0")).select(F.lit("reserved word").alias("check"), c("word").alias("key")),
        lexicon.filter(F.size("phones") == 0).select(F.lit("empty pronunciation").alias("check"), c("word").alias("key")),
        flat.join(known, "phone", "left_anti").select(F.lit("unknown phone").alias("check"), c("phone").alias("key")).distinct(),
        silence.select("phone").intersect(nonsilence.select("phone")).select(F.lit("phone in both sets").alias("check"), c("phone").alias("key")),
        lexicon.filter("prob is not null and not (prob > 0 and prob <= 1)").select(F.lit("probability").alias("check"), c("word").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts)


def dedup_hits(hits: DataFrame, gap: float = 0.5) -> DataFrame:
    """Keyword hits (kwid, file, channel, tbeg, dur, score), one of each cluster of near times, the best score.

    In time order a cluster holds the hits within ``gap`` of its first; the next hit begins another. That anchor
    depends on the one before, so each keyword and file is one stream of rows in order.
    """

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        anchor, best = 0.0, None
        for row in rows:
            *_, at, dur, score = row
            if best is None or at - anchor >= gap:
                if best:
                    yield best
                anchor, best = at, row
            elif (score, dur, -at) > (best[5], best[4], -best[3]):
                best = row
        if best:
            yield best

    cols = hits.select("kwid", "file", "channel", c("tbeg").cast("double").alias("tbeg"), c("dur").cast("double").alias("dur"), c("score").cast("double").alias("score"))
    by = ["kwid", "file", "channel"]
    return in_order(cols, by, ["tbeg", F.desc("dur"), F.desc("score")], walk, "kwid string, file string, channel string, tbeg double, dur double, score double")


def dedup_hits_chained(hits: DataFrame, gap: float = 0.5) -> DataFrame:
    """As :func:`dedup_hits`, but a cluster goes on as long as each hit is within ``gap`` of the one before: windows only."""
    from .helpers import lag, with_islands

    by, order = ["kwid", "file", "channel"], ["tbeg", "dur", "score"]
    s = with_islands(hits.select("kwid", "file", "channel", "tbeg", "dur", "score"), by, order, c("tbeg") - lag("tbeg", by, order) >= gap)
    best = F.max_by(F.struct("tbeg", "dur", "score"), F.struct("score", "dur", -c("tbeg")))
    return s.groupBy(*by, "island").agg(best.alias("b")).select(*by, "b.*")


def split_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` contiguous parts of nearly equal size; the first ones take the remainder."""
    from .helpers import numbered

    total = df.count()
    small, extra = divmod(total, n)
    k = c("_n") - 1
    part = F.when(k < extra * (small + 1), F.floor(k / (small + 1))).otherwise(extra + F.floor((k - extra * (small + 1)) / max(1, small)))
    return numbered(df, [order], "_n").withColumn("part", part + 1).drop("_n")


def split_speakers_evenly(utt2spk: DataFrame, n: int) -> DataFrame:
    """``n`` parts of which none shares a speaker: speaker i of m, in order, goes to part int(i n / m)."""
    speakers = utt2spk.select("spk").distinct()
    m = speakers.count()
    if m < n:
        raise ValueError("fewer speakers than parts")
    from .helpers import numbered

    part = F.floor((c("_n") - 1) * n / m) + 1
    return utt2spk.join(numbered(speakers, ["spk"], "_n").select("spk", part.alias("part")), "spk")


def balance_parts(sizes: DataFrame, n: int, near: int = 512) -> DataFrame:
    """Parts of whole speakers (spk, n_utts) of about equal utterances: boundaries move while that evens out neighbours.

    Speakers in order are dealt evenly at first. Then, part by part and again until nothing moves, the last speaker of a
    part goes to the next one, or the first of the next to it, where that brings their two loads closer and leaves no part empty.

    A boundary's moves need only the speakers beside it and the loads, which are differences of running sums. So
    speakers are numbered and summed in Spark, and the driver holds one number a boundary and the ``near`` speakers
    on either side of each; when a boundary has walked to the edge of what is held, the rows around it are read anew.
    Fewer speakers than parts are an error.
    """
    from .helpers import numbered, running_sum, small, store

    table = store(running_sum(numbered(sizes.select("spk", c("n_utts").cast("long").alias("n_utts")), ["spk"], "k"), ["k"], "n_utts", "before"), "sizes")
    m, total = table.agg(F.count("*"), F.sum("n_utts")).first()
    if m < n:
        raise ValueError("fewer speakers than parts")
    ends = [-(-p * m // n) for p in range(1, n)]  # speakers before each inner boundary
    held: dict[int, int] = {}  # n_utts by speaker number, from 0

    def fetch() -> None:
        blocks = sizes.sparkSession.createDataFrame([(b,) for b in {e // near + i for e in ends for i in (-1, 0, 1)}], "_b long")
        beside = table.withColumn("_b", F.expr(f"(k - 1) div {near}")).join(small(blocks), "_b", "left_semi")
        held.clear()
        held.update((r[0] - 1, r[1]) for r in beside.select("k", "n_utts").toLocalIterator())

    sums = [0, *(r[1] for r in sorted(table.filter(c("k").isin(ends)).select("k", c("before") + c("n_utts")).collect())), total] if ends else [0, total]
    changed = bool(ends)
    if changed:
        fetch()
    while changed:
        changed = False
        for p in range(n - 1):
            low, end, high = (ends[p - 1] if p else 0), ends[p], (ends[p + 1] if p + 2 < n else m)
            own, other = sums[p + 1] - sums[p], sums[p + 2] - sums[p + 1]
            if end - 1 not in held or end not in held:
                fetch()
            for x, step, stays in ((held[end - 1], -1, end - low > 1), (held[end], 1, high - end > 1)):
                if stays and abs(own + step * x - (other - step * x)) < abs(own - other):
                    ends[p], sums[p + 1], changed = end + step, sums[p + 1] + step * x, True
                    break
    bounds = sizes.sparkSession.createDataFrame([(p + 1, a, b) for p, (a, b) in enumerate(zip([0, *ends], [*ends, m]))], "part long, lo long, hi long")
    # one row a part: an equi-join on blocks of speakers, so that no row is compared with all parts
    block = max(1, m // n)
    wide = bounds.select("part", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).alias("_b"))
    rows = table.withColumn("_b", F.expr(f"(k - 1) div {block}")).join(small(wide), "_b").filter((c("k") > c("lo")) & (c("k") <= c("hi")))
    return rows.select("spk", "n_utts", "part")


def heldout_by_speaker(utt2spk: DataFrame, percent: float, seed: int = 777) -> DataFrame:
    """Rows with ``part`` cv or train: speakers in seeded order are held out while fewer than the percentage of utterances are."""
    from .helpers import running_sum

    n = running_sum(utt2spk.groupBy("spk").agg(F.count("*").alias("n")), [seeded("spk", seed), "spk"], "n", "_before")
    total = utt2spk.count()
    return utt2spk.join(n.select("spk", F.when(c("_before") < total * percent / 100, "cv").otherwise("train").alias("part")), "spk")


def heldout_by_utterance(utt2spk: DataFrame, percent: int, order: list[str]) -> DataFrame:
    """Rows with ``part`` train or cv: in order, the last ``percent`` in a hundred are held out, and the edge moves back to a change of speaker.

    Rows are numbered in two passes; a row meets the next by an equi-join on numbers, so no task sees all of them.
    """
    from .helpers import numbered, store

    rows = store(numbered(utt2spk, order, "_n"), "rows")
    total = rows.count()
    head = total - total * percent // 100
    nxt = rows.select((c("_n") - 1).alias("_n"), c("spk").alias("_next"))
    edges = rows.join(nxt, "_n", "left").filter((c("_n") <= head) & (c("_next").isNull() | (c("_next") != c("spk"))))
    edge = edges.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    return rows.withColumn("part", F.when(c("_n") <= edge, "train").otherwise("cv")).drop("_n")


def speakers_until(utt2spk: DataFrame, n: int, seed: int = 777) -> DataFrame:
    """Utterances of seeded-random speakers, taken while the utterances so far are fewer than ``n``."""
    from .helpers import running_sum

    k = running_sum(utt2spk.groupBy("spk").agg(F.count("*").alias("n")), [seeded("spk", seed), "spk"], "n", "_b")
    return utt2spk.join(k.filter(c("_b") < n).select("spk"), "spk", "left_semi")


def n_per_speaker(utt2spk: DataFrame, k: int, order: str = "utt") -> DataFrame:
    """``k`` evenly strided utterances of each speaker, or all of a speaker with fewer."""
    w = Window.partitionBy("spk")
    r = utt2spk.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_s", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / k)))
    return r.filter((c("_r") % c("_s") == 0) & (c("_r") < k * c("_s"))).drop("_r", "_s")


def kfold(df: DataFrame, k: int, id_col: str, seed: int = 777) -> DataFrame:
    """Round-robin folds over the seeded order of ids."""
    from .helpers import numbered

    return numbered(df, [seeded(id_col, seed), id_col], "_n").withColumn("fold", (c("_n") - 1) % k).drop("_n")


def prefix_subset(df: DataFrame, prefixes: DataFrame, col: str) -> DataFrame:
    """Rows whose key starts with a listed prefix, once each: the key's own prefixes of listed lengths meet in an equi-join."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # a few lengths
    if not lengths:
        return df.limit(0)
    own = F.array(*[F.substring(col, 1, n) for n in lengths])
    hit = df.select(col, F.explode(own).alias("prefix")).join(prefixes.select("prefix"), "prefix", "left_semi").select(col).distinct()
    return df.join(hit, col, "left_semi")


def training_shards(egs: DataFrame, n_valid: int, n_train: int, jobs: int, iters: int, seed: int = 777) -> DataFrame:
    """Role of each utterance: valid, the train subset for diagnosis, and job and iteration of all that are not valid."""
    from .helpers import numbered

    r = numbered(egs, [seeded("utt", seed), "utt"], "_n")
    role = F.when(c("_n") <= n_valid, "valid").when(c("_n") <= n_valid + n_train, "train_diagnostic").otherwise("train")
    k = c("_n") - n_valid - 1
    return r.withColumn("role", role).withColumn("job", F.when(k >= 0, k % jobs + 1)).withColumn("iter", F.when(k >= 0, F.floor(k / jobs) % iters)).drop("_n")


def relabel(egs: DataFrame, alignment: DataFrame) -> DataFrame:
    """Examples (utt, frame, label) with the label of the new alignment where it has one."""
    new = alignment.select("utt", "frame", c("label").alias("_new"))
    return egs.join(new, ["utt", "frame"], "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def upsert(current: DataFrame, changes: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """A new snapshot: changed fields replace those of the key's row unless null, new keys are added, deleted ones go."""
    cols = [x for x in current.columns if x != key]
    new = changes.select(key, *[c(x).alias(f"_{x}") for x in cols if x in changes.columns], *([c(deleted).alias("_deleted")] if deleted else []))
    out = current.join(new, key, "full")
    if deleted:
        out = out.filter(~F.coalesce("_deleted", F.lit(False)))
    return out.select(key, *[F.coalesce(f"_{x}", x).alias(x) if x in changes.columns else c(x) for x in cols])


def job_action(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply requests (jobid, action): delete marks X, clear drops the error text, resubmit puts a failed job back to P."""
    j = jobs.join(requests, "jobid", "left")
    status = F.when(c("action") == "delete", "X").when((c("action") == "resubmit") & (c("status") == "E"), "P").otherwise(c("status"))
    return j.withColumn("errstatus", F.when(c("action") == "clear", None).otherwise(c("errstatus"))).withColumn("status", status).drop("action")


def cut_speakers(utt2spk: DataFrame, most: int, order: str = "utt") -> DataFrame:
    """Consecutive groups of at most ``most`` utterances of each speaker, as speakers ``spk-%06x`` from 1."""
    k = F.floor((F.row_number().over(Window.partitionBy("spk").orderBy(order)) - 1) / most) + 1
    return utt2spk.withColumn("sub", F.concat("spk", F.lit("-"), F.format_string("%06x", k)))


def sub_speakers_by_size(sizes: DataFrame, least: int, order: str = "utt") -> DataFrame:
    """Groups of a speaker's utterances (utt, spk, n): a group closes when it has ``least`` frames and as many remain."""

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        have, done, k = 0, 0, 0
        for utt, spk, n, total, _ in rows:
            have, done = have + n, done + n
            yield (utt, spk, n, f"{spk}-{k:06x}")
            if have >= least and total - done >= least:
                k, have = k + 1, 0

    cols = sizes.select("utt", "spk", c("n").cast("long").alias("n"), F.sum("n").over(Window.partitionBy("spk")).cast("long").alias("total"), c(order).alias("_order"))
    return in_order(cols, ["spk"], ["_order"], walk, "utt string, spk string, n long, sub string")


def whole_speakers(utts: DataFrame, utt2spk: DataFrame) -> DataFrame:
    """Every utterance of the speakers of the chosen ones."""
    spk = utt2spk.join(utts.select("utt"), "utt", "left_semi").select("spk")
    return utt2spk.join(spk, "spk", "left_semi")


def perturbed_union(df: DataFrame, variants: list[str], cols: list[str]) -> DataFrame:
    """A copy of all rows for each variant, its ids prefixed; ``uniq`` keeps the first id as it was."""
    x = df.withColumn("uniq", c(cols[0])).withColumn("_v", F.explode(F.array(*[F.lit(v) for v in variants])))
    for k in cols:
        x = x.withColumn(k, F.concat("_v", k))
    return x.drop("_v")
