"""Rules over a recording in which each step depends on the ones before: splices, segments, energy, smoothed scores."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from .helpers import range_join, small, store
from .streamed import in_order

c = F.col


def splice_ctm(ctm: DataFrame, precision: float = 0.05) -> DataFrame:
    """Words (utt, channel, pos, start, dur, word) in file order, with gaps filled and overlapping stretches spliced.

    A word that begins after the end of the one before gets an ``<eps>`` row for the gap. One that begins before that
    end comes from a stretch that overlaps the last: if it repeats a kept word (the same word, start and duration
    within ``precision``) among those that end after its start, the words kept since that one are taken back; the
    repeat itself is dropped in any case. The kept words of a recording are a stack in memory; nothing else is.
    """

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for _, _, _, start, dur, word in rows:
            if kept:
                end = round(kept[-1][0] + kept[-1][1], 2)
                if end > start:
                    at = len(kept) - 1
                    while at >= 0 and kept[at][0] + kept[at][1] > start:
                        s, d, w = kept[at]
                        if w == word and abs(s - start) < precision and abs(d - dur) < precision:
                            del kept[at + 1 :]
                            break
                        at -= 1
                    continue
                if end < start:
                    kept.append((end, round(start - end, 2), "<eps>"))
            kept.append((start, dur, word))
        yield from ((*key, *x) for x in kept)

    cols = ctm.select("utt", "channel", "pos", "start", "dur", "word")
    return in_order(cols, ["utt", "channel"], ["pos"], walk, "utt string, channel string, start double, dur double, word string")


# --- segments of an aligned recording

def aligned_words(ctm: DataFrame, pairs: DataFrame, special: str = "<eps>") -> DataFrame:
    """Recognized words laid beside their alignment: utt, place, ref, hyp, start, dur, kind.

    ``ctm`` has utt, pos, start, dur, word (``<eps>`` is silence); ``pairs`` has utt, pos, ref, hyp. The k-th recognized
    word of the pairs is the k-th word of the CTM; where they differ the input is wrong, which is an error. Silences
    stand before the pair of the word that follows them; those after the last word are dropped. Kind 0 is a silence,
    1 a pair.
    """
    ahead = Window.partitionBy("utt").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    times = ctm.withColumn("n", F.sum((c("word") != "<eps>").cast("long")).over(ahead))
    heard = pairs.withColumn("m", F.sum((c("hyp") != special).cast("long")).over(ahead))
    words = times.filter(c("word") != "<eps>").select("utt", c("n").alias("m"), "start", "dur", "word")
    both = heard.join(words, ["utt", "m"], "left")
    right = (c("hyp") == special) | (c("hyp") == c("word"))
    checked = F.when(F.coalesce(right, F.lit(False)), c("hyp")).otherwise(F.raise_error(F.concat(F.lit("pairs and words differ in "), c("utt"))).cast("string"))
    gone = c("hyp") == special
    main = both.select(
        "utt", c("pos").alias("place"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("turn"), "ref", checked.alias("hyp"), F.when(~gone, c("start")).alias("start"),
        F.when(~gone, c("dur")).alias("dur"),
    )
    carrier = heard.filter(c("hyp") != special).select("utt", "m", c("pos").alias("place"))
    pauses = times.filter(c("word") == "<eps>").select("utt", (c("n") + 1).alias("m"), c("pos").alias("turn"), "start", "dur")
    quiet = pauses.join(carrier, ["utt", "m"]).select(
        "utt", "place", F.lit(0).alias("kind"), c("turn").cast("long").alias("turn"), F.lit("<eps>").alias("ref"), F.lit("<eps>").alias("hyp"), "start", "dur"
    )
    return main.unionByName(quiet)


def entries(rows: Iterator[tuple], special: str) -> Iterator[list]:
    """Entries [word, start, dur, errors] of a recording; a word too many adds its time and an error to the entry before."""
    last = None
    for _, _, kind, _, ref, hyp, start, dur in rows:
        if kind == 0:
            new = ["<eps>", start, dur, 0]
        elif hyp == special:  # a word that was not recognized takes no time
            new = [ref, last[1] + last[2] if last else 0.0, 0.0, 1]
        elif ref == special and ref != hyp:
            if last:
                last[2] += dur
                last[3] += 1
                continue
            new = ["<eps>", start, dur, 1]
        else:
            new = [ref, start, dur, int(ref != hyp)]
        if last:
            yield last
        last = new
    if last:
        yield last


class Cutter:
    """Cuts one recording's entries into segments; holds those since the last cut, and the silence before them."""

    def __init__(self, utt: str, longest: float, shortest: float, silence: float, cutoff: float | None):
        self.utt, self.longest, self.shortest, self.silence, self.cutoff = utt, longest, shortest, silence, cutoff
        self.before: list[list] = []  # the run of silences that the last segment ends with
        self.own: list[list] = []
        self.count = 0

    def segment(self, first: int, last: int) -> tuple | None:
        """The segment of own entries first to last, without silences at its ends, or None if it is dropped."""
        x = self.own
        while first <= last and x[first][0] == "<eps>":
            first += 1
        while last >= first and x[last][0] == "<eps>":
            last -= 1
        if first > last:
            return None
        words = [e[0] for e in x[first : last + 1] if e[0] != "<eps>"]
        errors = sum(e[3] for e in x[first : last + 1])
        if self.cutoff is not None and errors / len(words) > self.cutoff:
            return None
        lead = first
        while lead > 0 and x[lead - 1][0] == "<eps>":
            lead -= 1
        begin = self.before[0][1] if lead == 0 and self.before else x[lead][1]
        tail = last
        while tail + 1 < len(x) and x[tail + 1][0] == "<eps>":
            tail += 1
        most = self.silence / 2
        start = x[first][1] - min(most, (x[first][1] - begin) / 2)
        end = x[last][1] + x[last][2] + min(most, (x[tail][1] + x[tail][2] - x[last][1] - x[last][2]) / 2)
        out = (self.utt, f"{self.utt}_{self.count:05d}", round(start, 2), round(end, 2), len(words), errors, " ".join(words))
        self.count += 1
        return out

    def drop(self, n: int) -> None:
        """Forget the first n own entries but for the silences at their end."""
        gone = self.before + self.own[:n]
        keep = len(gone)
        while keep and gone[keep - 1][0] == "<eps>":
            keep -= 1
        self.before, self.own = gone[keep:], self.own[n:]

    def split_at(self, first: int, limit: float) -> int:
        """The last entry that ends within ``limit`` of the start of entry ``first``; that one if none does."""
        x = self.own
        return next((k for k in range(len(x) - 1, first - 1, -1) if x[k][1] + x[k][2] - x[first][1] <= limit), first)

    def split(self) -> Iterator[tuple]:
        """Cut all own entries: pieces of the limit while over one and a half of it is left, then halves; what is over stays."""
        at, last = 0, len(self.own) - 1

        def left() -> float:
            return self.own[last][1] + self.own[last][2] - self.own[at][1] if at <= last else 0.0

        while at <= last and (length := left()) > self.longest:
            point = self.split_at(at, self.longest if length > 1.5 * self.longest else length / 2 + 0.01)
            yield self.segment(at, point)
            at = point + 1
            if length <= 1.5 * self.longest:
                break
        if at <= last:
            point = self.split_at(at, self.longest + 0.01)
            yield self.segment(at, point)
            at = point + 1
        self.drop(at)

    def length(self) -> float:
        """Seconds from the first word to the end of the last."""
        first = next((e for e in self.own if e[0] != "<eps>"), None)
        last = next((e for e in reversed(self.own) if e[0] != "<eps>"), None)
        return last[1] + last[2] - first[1] if first else 0.0

    def run(self, stream: Iterator[list]) -> Iterator[tuple]:
        error_before, now = 0, next(stream, None)
        while now:
            after = next(stream, None)
            self.own.append(now)
            if now[0] == "<eps>" and now[2] > self.silence and not error_before and not (after and after[3]):
                n = self.length()
                if n > self.longest:
                    yield from self.split()
                elif n >= self.shortest:
                    yield self.segment(0, len(self.own) - 1)
                    self.drop(len(self.own))
            error_before, now = now[3], after
        if self.own:
            yield from self.split()


def cut_aligned(
    ctm: DataFrame, pairs: DataFrame, longest: float = 10.0, shortest: float = 2.0, silence: float = 0.5, wer_cutoff: float | None = None, special: str = "<eps>"
) -> DataFrame:
    """Training segments of aligned recordings: utt, seg, start, end, n_words, n_err, text.

    A recording is cut at a silence of more than ``silence`` seconds without an error on either side, once the words so
    far take ``shortest`` seconds. Where they take more than ``longest``, the stretch is split by force: into pieces that
    end with the last word within the limit while more than one and a half limits are left, then in half; what
    lies behind the last split begins the next stretch. Segments keep half of the silences around them, up to half of ``silence``
    on each side; those with more errors a word than ``wer_cutoff`` are dropped. Words and pairs meet in joins
    (:func:`aligned_words`), and each recording is one stream of rows, of which the stretch since the last cut is held.
    """

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        return (x for x in Cutter(key[0], longest, shortest, silence, wer_cutoff).run(entries(rows, special)) if x)

    return in_order(aligned_words(ctm, pairs, special), ["utt"], ["place", "kind", "turn"], walk, "utt string, seg string, start double, end double, n_words long, n_err long, text string")


# --- speech by energy

def window_levels(frames: DataFrame, window: int, extremes: int, least: int) -> DataFrame:
    """Loudness of each window of a recording (rec, frame, rms): rec, win, top, and over all as window -1.

    ``top`` is the mean of the ``extremes`` loudest frames but the very loudest (all of them, if there are fewer). The last frame belongs to no
    window, and windows of up to ``least`` frames, but for the first, have no estimate.
    """
    n = frames.groupBy("rec").agg((F.max("frame") + 1).alias("n"))
    f = frames.join(n, "rec")
    whole = f.select("rec", "frame", "rms", F.lit(-1).cast("long").alias("win"))
    f = whole.unionByName(f.filter(c("frame") < c("n") - 1).select("rec", "frame", "rms", F.floor(c("frame") / window).alias("win")))
    w = Window.partitionBy("rec", "win")
    f = f.withColumn("k", F.row_number().over(w.orderBy(F.desc("rms"), "frame"))).withColumn("size", F.count("*").over(w))
    loud = f.filter(((c("k") > 1) | (c("size") == 1)) & (c("k") <= extremes + 1))
    top = loud.groupBy("rec", "win").agg(F.avg("rms").alias("top"), F.max("size").alias("size"))
    return top.filter((c("win") <= 0) | (c("size") > least)).select("rec", "win", "top")


def energy_states(frames: DataFrame, window: int = 6000, extremes: int = 1000, least: int = 2000, gap: int = 50, floor: float = 0.2) -> DataFrame:
    """Speech spans (rec, first, last) of frames numbered from 0 (rec, frame, rms), with a level that follows the recording.

    Speech begins at a frame that reaches a third of the level; it ends at the first of more than ``gap`` frames
    below. The level is the loudness of a window (:func:`window_levels`), at least ``floor`` of that of the whole recording.
    Every ``window`` frames, in silence or at the next silence, the next window's level takes over; the first change
    is at frame 0, so a window's level serves from the window before it on. A span still open ends with the recording.

    The levels come from window aggregates; each recording is then one stream of frames, of which a few numbers are held.
    """
    levels = window_levels(frames, window, extremes, least)

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        level, whole, win, due, state, begin, below, frame = {}, 0.0, 0, False, 0, 0, 0, -1
        limit = 0.0
        for _, kind, frame, value in rows:
            if kind == 0:
                level[frame] = value
                whole = level.get(-1, 0.0)
                limit = max(level.get(0, whole), floor * whole) / 3
                continue
            due = due or frame % window == 0
            if state == 0:
                if due:
                    due, win = False, win + 1
                    if win in level:
                        limit = max(level.pop(win), floor * whole) / 3
                if value >= limit:
                    state, begin = 1, frame
            elif state == 1:
                if value < limit:
                    state, below = 2, frame
            elif value >= limit:
                state = 1
            elif frame - below > gap:
                state = 0
                yield (key[0], begin, below)
        if state:
            yield (key[0], begin, frame)

    rows = levels.select("rec", F.lit(0).alias("kind"), c("win").alias("at"), c("top").alias("value")).unionByName(
        frames.select("rec", F.lit(1).alias("kind"), c("frame").cast("long").alias("at"), c("rms").alias("value"))
    )
    return in_order(rows, ["rec"], ["kind", "at"], walk, "rec string, first long, last long")


def pitched(spans: DataFrame, pitch: DataFrame, share: float = 0.1, width: int = 500) -> DataFrame:
    """Spans (rec, first, last) of whose frames (rec, frame, pitch) more than ``share`` have a pitch, by a range join."""
    voiced = pitch.filter(c("pitch") > 0).select("rec", "frame")
    hits = range_join(voiced, spans, ["rec"], "frame", "first", "last", width).filter((c("frame") >= c("first")) & (c("frame") < c("last")))
    n = hits.groupBy("rec", "first", "last").agg(F.count("*").alias("n"))
    kept = n.filter(c("n") > share * (c("last") - c("first")))
    return kept.select("rec", "first", "last")


# --- scores smoothed in place

def smooth_round(state: DataFrame, window: int, factor: float) -> DataFrame:
    """One pass over each recording: scores smoothed in time order, in place, and the best label that is still in use.

    A segment's scores gain ``factor`` times the mean, weighted by clipped overlap, of its neighbours' within ``window``:
    those before it as this pass has left them (but for a recording's first), those after it as the last pass did.
    Neighbours are taken outwards until one does not reach the window. Only segments that windows may still reach are held.
    """

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        done: deque = deque()  # segments before, smoothed: start, end, scores
        ahead: deque = deque()
        number = 0

        def smooth() -> tuple:
            nonlocal number
            _, event, start, end, scores, models, out = ahead.popleft()
            scores, total, mean = list(scores), 0, [0.0] * len(scores)
            for k in range(len(done) - 1, -1, -1):
                s, e, x = done[k]
                if e <= start - window:
                    for _ in range(k + 1):  # no later segment reaches past this one
                        done.popleft()
                    break
                w = e - max(s, start - window)
                total += w
                mean = [m + w * v for m, v in zip(mean, x)]
            for _, _, s, e, x, _, _ in ahead:
                if s >= end + window:
                    break
                w = min(e, end + window) - s
                total += w
                mean = [m + w * v for m, v in zip(mean, x)]
            if total > 0:
                scores = [v + factor * m / total for v, m in zip(scores, mean)]
            use = [(v, i) for i, (v, m) in enumerate(zip(scores, models)) if m not in out]
            best = models[max(use, key=lambda p: (p[0], -p[1]))[1]] if use else None
            if number:
                done.append((start, end, scores))
            number += 1
            return (key[0], event, start, end, scores, models, out, best)

        for row in rows:
            ahead.append(row)
            while ahead[0] is not row and ahead[0][3] + window <= row[2]:
                yield smooth()
        while ahead:
            yield smooth()

    schema = "rec string, event_id long, start_cs long, end_cs long, scores array<double>, models array<string>, out array<string>, best string"
    return in_order(state.select("rec", "event_id", "start_cs", "end_cs", "scores", "models", "out"), ["rec"], ["start_cs", "event_id"], walk, schema)


def smooth_and_discard(scores: DataFrame, window_cs: int, factor: float, least_cs: int, most_rounds: int = 50) -> DataFrame:
    """Labels of segments by smoothed scores (rec, event_id, start_cs, end_cs, model, score): adds label and rounds.

    Each round smooths the scores of the round before (:func:`smooth_round`) and takes the best label of each segment.
    A label of less than ``least_cs`` of speech in its recording is discarded and the recording goes through another
    round without it, until none is discarded; with ``least_cs`` of 0 there is one round. Rounds are stored tables, of
    recordings that still change only. Columns rec, event_id, label (null if all are discarded), rounds.
    """
    order = F.array_sort(F.collect_list(F.struct("model", "score")))  # a recording's few models
    state = scores.groupBy("rec", "event_id", "start_cs", "end_cs").agg(order.alias("m"))
    state = state.select("rec", "event_id", "start_cs", "end_cs", c("m.score").alias("scores"), c("m.model").alias("models"), F.array().cast("array<string>").alias("out"))
    settled: list[DataFrame] = []
    for turn in range(1, most_rounds + 1):
        now = store(smooth_round(state, window_cs, factor), "smooth")
        labelled = now.select("rec", "event_id", c("best").alias("label"), F.lit(turn).alias("rounds"))
        if not least_cs:
            return labelled
        speech = now.groupBy("rec", "best").agg(F.sum(c("end_cs") - c("start_cs")).alias("cs"))
        used = now.groupBy("rec").agg(F.first("models").alias("models"), F.first("out").alias("out"))
        each = used.select("rec", "out", F.explode(F.array_except("models", "out")).alias("best")).join(speech, ["rec", "best"], "left")
        poor = each.filter(F.coalesce("cs", F.lit(0)) < least_cs).groupBy("rec").agg(F.sort_array(F.collect_set("best")).alias("poor"))
        poor = store(poor, "discard")
        if poor.isEmpty():
            settled.append(labelled)
            break
        settled.append(labelled.join(small(poor), "rec", "left_anti"))
        state = now.join(small(poor), "rec").withColumn("out", F.concat("out", "poor")).drop("poor", "best")
    else:
        raise RuntimeError("labels did not settle")
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out
