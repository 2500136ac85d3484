"""Transcript scoring, keyword decisions and rescoring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .aggs import keyword_thresholds

c = F.col
EPS = "<eps>"
#: Moves of an alignment: a pair, a token of the reference alone, a token of the hypothesis alone.
PAIR, REF, HYP = 0, 1, 2
#: Pairs of texts with a larger table of edit distances (cells), and those that fewer others resemble in length, go through
#: :func:`edit_path` one by one.
CELLS, FEW = 16_000_000, 24
#: Bytes of marks that texts worked through together may take, words of both sides that are aligned at a time, rows of a batch made of them.
MARKS, WORDS, ROWS = 64_000_000, 8_000_000, 250_000


def edit_path(ref: list[str], hyp: list[str]) -> list[tuple[str, str]]:
    """A cheapest alignment as pairs, ``<eps>`` on the side that lacks a token; matches, then substitutions, are preferred.

    Rows of the table of edit distances are held as whole numbers of one bit a column: where a cell is one more
    (``up``) or one less (``down``) than its left neighbour, where it equals its diagonal neighbour (``same``) and
    where it is one more than the cell above (``more``). A row follows from the one above by a few operations on
    such numbers. Where all rows would take more than ``MARKS`` bytes, only every gap-th is kept and the walk back makes
    the rows between two of them again, so memory grows with the length to the power 1.5, in bits.
    """
    n, m = len(ref), len(hyp)
    full = (1 << m) - 1
    places: dict[str, int] = {}
    for j, x in enumerate(hyp):
        places[x] = places.get(x, 0) | 1 << j

    def below(x: str, up: int, down: int) -> tuple[int, int, int, int]:
        equal = places.get(x, 0)
        same = (((equal & up) + up) ^ up | equal | down) & full
        more, less = down | full ^ (same | up), same & up
        left = (more << 1 | 1) & full
        return less << 1 & full | full ^ (same | left), left & same, same, more

    whole = n * m <= 4 * MARKS
    gap = max(1, math.isqrt(n))
    kept, row, rows = [(full, 0)], (full, 0), []
    for i in range(1, n + 1):
        *row, same, more = below(ref[i - 1], *row)
        if whole:
            rows.append((same, more))
        elif i % gap == 0:
            kept.append(row)
    first = 0 if whole else n + 1  # rows first + 1, first + 2, ...: where they equal the diagonal, where they are more than above
    out, i, j = [], n, m
    while i or j:
        if i and i - 1 < first:
            first = (i - 1) // gap * gap
            row, rows = kept[first // gap], []
            for k in range(first, i):
                up, down, same, more = below(ref[k], *row)
                row = up, down
                rows.append((same, more))
        same, more = rows[i - first - 1] if i else (0, 0)
        if i and j and (same >> (j - 1) & 1) == (ref[i - 1] == hyp[j - 1]):
            out.append((ref[i - 1], hyp[j - 1]))
            i, j = i - 1, j - 1
        elif i and (not j or more >> (j - 1) & 1):
            out.append((ref[i - 1], EPS))
            i -= 1
        else:
            out.append((EPS, hyp[j - 1]))
            j -= 1
    return out[::-1]


def edit_moves(refs: list[np.ndarray], hyps: list[np.ndarray]) -> list[np.ndarray]:
    """Moves of the alignments of :func:`edit_path` for many pairs of texts (numbers for words), worked through row by row together.

    The bits of a row are those of :func:`edit_path`, in an array of 64-bit numbers where each pair has a field: bit j is column
    j of its table, bit 0 the column before the first word, and one bit above the last takes carries. What the way
    back asks of a cell is kept, two bits each: whether it follows from its diagonal neighbour, and whether from the
    cell above. The way back is taken for all pairs at once too. Pairs should be of about one length.
    """
    n, m = (np.array([len(x) for x in side]) for side in (refs, hyps))
    width = (m + 65) // 64
    at = np.cumsum(width) - width
    size, rows = int(width.sum()), int(n.max())
    diagonal, above = np.zeros((rows + 1, size), np.uint64), np.zeros((rows + 1, size), np.uint64)
    slot = np.full(max(x.max(initial=0) for side in (refs, hyps) for x in side) + 1, -1)
    one, top, every = np.uint64(1), np.uint64(63), ~np.uint64(0)
    full, first, before = (np.zeros(size, np.uint64) for _ in range(3))
    for r, h, a, w in zip(refs, hyps, at.tolist(), width.tolist()):
        column = np.arange(1, len(h) + 1)
        bit = one << (column & 63).astype(np.uint64)
        slot[h] = column - 1
        places = np.zeros((len(h) + 1, w), np.uint64)  # the last row is of words that the other side lacks
        np.add.at(places.ravel(), slot[h] * w + (column >> 6), bit)
        diagonal[1 : len(r) + 1, a : a + w] = places[slot[r]]
        slot[h] = -1
        np.add.at(full, a + (column >> 6), bit)
        first[a], before[a] = 2, 1

    def shifted(x: np.ndarray) -> np.ndarray:
        y = x << one
        y[1:] |= x[:-1] >> top
        return y

    def added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = x + y
        over = total < y
        if over.any():
            made, passed = (int.from_bytes(np.packbits(z, bitorder="little").tobytes(), "little") for z in (over, total == every))
            into = ((made << 1) + passed) ^ passed
            total += np.unpackbits(np.frombuffer(into.to_bytes(size // 8 + 2, "little"), np.uint8), count=size, bitorder="little")
        return total

    up, down = full, np.zeros(size, np.uint64)
    for equal, over in zip(diagonal[1:], above[1:]):
        same = ((added(equal & up, up) ^ up) | equal | down) & full
        more, less = down | (full ^ (same | up)), same & up
        left = (shifted(more) | first) & full
        up, down = (shifted(less) & full) | (full ^ (same | left)), left & same
        np.bitwise_or(more, before, out=over)
        equal ^= full ^ same
    diagonal, above = diagonal.ravel(), above.ravel()
    i, j, length, steps = n.copy(), m.copy(), np.zeros(len(n), int), []
    while (live := (i | j) > 0).any():
        cell, bit = i * size + at + (j >> 6), (j & 63).astype(np.uint64)
        d, u = ((x[cell] >> bit & one).astype(np.int8) for x in (diagonal, above))
        steps.append((1 - d) * (HYP - u))
        length += live
        i -= d | u
        j -= (d | (1 - u)) & live
    table = np.array(steps, np.uint8).reshape(len(steps), len(n))
    return [table[:x, k][::-1] for k, x in enumerate(length)]


def moves(refs: list[np.ndarray], hyps: list[np.ndarray]) -> list[np.ndarray]:
    """Moves of each pair of texts. Equal starts and ends are paired directly, so a table is as large as what differs."""
    heads, cores, out = [], [], [np.zeros(0, np.uint8)] * len(refs)
    for r, h in zip(refs, hyps):
        k = min(len(r), len(h))
        a = k if (same := r[:k] == h[:k]).all() else int(same.argmin())
        k -= a
        z = k if (same := r[len(r) - k :][::-1] == h[len(h) - k :][::-1]).all() else int(same.argmin())
        heads.append((a, z))
        cores.append((r[a : len(r) - z], h[a : len(h) - z]))
    one_by_one, rest = [], []
    for k in sorted(range(len(cores)), key=lambda k: -len(cores[k][0])):
        r, h = cores[k]
        if len(r) and len(h):
            (one_by_one if len(r) * len(h) > CELLS else rest).append(k)
        else:
            out[k] = np.full(len(r) + len(h), REF if len(r) else HYP, np.uint8)
    while rest:
        most, marks, some = len(cores[rest[0]][0]), 0, 0
        while some < len(rest) and 2 * len(cores[rest[some]][0]) + 32 >= most and (marks := marks + most * (len(cores[rest[some]][1]) // 4 + 16)) <= MARKS:
            some += 1
        group, rest = rest[: max(some, 1)], rest[max(some, 1) :]
        if len(group) < FEW:
            one_by_one += group
            continue
        for k, x in zip(group, edit_moves(*zip(*(cores[k] for k in group)))):
            out[k] = x
    for k in one_by_one:
        out[k] = np.array([REF if y is EPS else HYP if x is EPS else PAIR for x, y in edit_path(*(x.tolist() for x in cores[k]))], np.uint8)
    return [np.concatenate([np.zeros(a, np.uint8), x, np.zeros(z, np.uint8)]) for (a, z), x in zip(heads, out)]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For slices of the texts (utt, r, h): the names, rows of each, and per row the words' numbers on both sides, with the words."""
    for b in batches:
        sizes = [pc.fill_null(pc.list_value_length(b.column(x)), 0).to_numpy(zero_copy_only=False) for x in "rh"]
        total = np.cumsum(sizes[0] + sizes[1])
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + WORDS, "right")))
            some = b.slice(first, last - first)
            words = [pc.list_flatten(some.column(x)) for x in "rh"]
            coded = pa.concat_arrays([*words, pa.array([EPS], words[0].type)]).dictionary_encode("encode")
            codes, cut = coded.indices.to_numpy(), [np.cumsum(x[first : last - 1]) for x in sizes]
            own = codes[: len(words[0])], codes[len(words[0]) : -1]
            made = moves(*(np.split(x, k) for x, k in zip(own, cut)))
            step = np.concatenate(made)
            sides = []
            for x, gap in zip(own, (HYP, REF)):
                side = np.full(len(step), codes[-1])
                side[step != gap] = x
                sides.append(side)
            yield some.column("utt"), np.array([len(x) for x in made]), *sides, coded.dictionary, codes[-1]
            first = last


def align_rows(both: DataFrame) -> DataFrame:
    """Aligned pairs (utt, pos, ref, hyp) of texts that stand side by side (utt, r, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for utt, n, ref, hyp, words, _ in _aligned(batches):
            pos = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(np.arange(len(n)), n)
            for k in range(0, len(of), ROWS):
                taken = [names.take(pa.array(x[k : k + ROWS])) for names, x in ((utt, of), (words, ref), (words, hyp))]
                yield pa.RecordBatch.from_arrays([taken[0], pa.array(pos[k : k + ROWS]), *taken[1:]], ["utt", "pos", "ref", "hyp"])

    return both.select(c("utt").cast("string").alias("utt"), "r", "h").mapInArrow(run, "utt string, pos long, ref string, hyp string")


def error_rows(both: DataFrame) -> DataFrame:
    """Correct, substituted, inserted and deleted words (utt, c, s, i, d) of each row of texts side by side (utt, r, h).

    The classes are those of :func:`aggs.classify`, counted where the texts are aligned: no pair leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for utt, n, ref, hyp, words, eps in _aligned(batches):
            null = words.is_null().to_numpy(zero_copy_only=False)
            d, i = hyp == eps, (ref == eps) & (hyp != eps)
            s = ~(d | i | null[ref] | null[hyp]) & (ref != hyp)
            ends = np.cumsum(n)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (~(d | i | s), s, i, d)]
            yield pa.RecordBatch.from_arrays([utt, *(pa.array(x, pa.int64()) for x in sums)], ["utt", *"csid"])

    return both.select(c("utt").cast("string").alias("utt"), "r", "h").mapInArrow(run, "utt string, c long, s long, i long, d long")


def side_by_side(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """The texts of both sides (utt, words) as rows (utt, r, h), where both have the utterance."""
    return ref.select("utt", c("words").alias("r")).join(hyp.select("utt", c("words").alias("h")), "utt")


def align(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Aligned pairs (utt, pos, ref, hyp) of the utterances of both sides (utt, words)."""
    return align_rows(side_by_side(ref, hyp))


def corpus_wer(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Totals over the utterances present in ``hyp``."""
    return total_errors(side_by_side(ref, hyp))


def total_errors(both: DataFrame) -> DataFrame:
    """Totals over texts that stand side by side (utt, r, h)."""
    t = error_rows(both).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "csid"])
    return t.withColumn("n_word", c("c") + c("s") + c("d")).withColumn("err", c("s") + c("i") + c("d"))


def pretty(pairs: DataFrame) -> DataFrame:
    """Three lines an utterance (ref, hyp, op), each token centred in the width of the wider of its pair.

    The pairs of an utterance are gathered once, unpadded; the lines are made of them.
    """
    from .aggs import classify

    def line(of):
        def token(r):
            w, x = F.greatest(F.length(r["ref"]), F.length(r["hyp"])), of(r)
            left = F.floor((w - F.length(x)) / 2).cast("int")
            return F.rpad(F.concat(F.repeat(F.lit(" "), left), x), w, F.lit(" "))

        return F.array_join(F.transform("_p", token), " ")

    g = pairs.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "ref", "hyp"))).alias("_p"))
    return g.select("utt", line(lambda r: r["ref"]).alias("ref"), line(lambda r: r["hyp"]).alias("hyp"), line(lambda r: classify(r["ref"], r["hyp"])).alias("op"))


def nbest_pick(nbest: DataFrame, grid: DataFrame, digits: int = 6) -> DataFrame:
    """Best hypothesis of each utterance at each grid point (lmwt, penalty): least lm * lmwt + ac + penalty * n_words.

    ``nbest`` has utt, hyp, lm, ac, n_words; the grid is short. Costs that are equal to ``digits`` digits tie, and the
    least name wins, so that the last bits of a sum decide nothing.
    """
    cost = F.round(c("lm") * c("lmwt") + c("ac") + c("penalty") * c("n_words"), digits)
    return nbest.join(F.broadcast(grid)).withColumn("cost", cost).groupBy("utt", "lmwt", "penalty").agg(F.min_by("hyp", F.struct("cost", "hyp")).alias("hyp"))


def keyword_decisions(hits: DataFrame, normalize: bool = False, yes_cutoff: int = 0, remove_no: bool = False, digits: int = 0) -> DataFrame:
    """YES where the score passes the keyword's threshold; ``normalize`` maps the threshold to one half.

    ``digits`` rounds the scores once the decisions are made. Beside score and decision stand the keyword's ``threshold`` and the
    ``raw`` score. With a cutoff, a keyword with over twice as many YES keeps only its first hit, and others their first ``cutoff``.
    """
    t = keyword_thresholds(hits).select("kwid", "threshold")
    h = hits.join(t, "kwid").withColumn("raw", c("score"))
    if normalize:
        yes, no = (1 - c("threshold")) * c("score"), (1 - c("score")) * c("threshold")
        h = h.withColumn("score", yes / (yes + no))
    limit = F.lit(0.5) if normalize else c("threshold")
    h = h.withColumn("decision", F.when(c("score") > limit, "YES").otherwise("NO"))
    if digits:
        h = h.withColumn("score", F.round("score", digits))
    if yes_cutoff:
        w = Window.partitionBy("kwid")
        n_yes = F.count_if(c("decision") == "YES").over(w)
        rank = F.row_number().over(w.orderBy(F.desc("score"), "file", "tbeg", "utt", "pos"))
        yes_rank = F.sum((c("decision") == "YES").cast("int")).over(w.orderBy(F.desc("score"), "file", "tbeg", "utt", "pos").rowsBetween(Window.unboundedPreceding, 0))
        h = h.withColumn("_n", n_yes).withColumn("_r", rank).withColumn("_y", yes_rank)
        cut = ((c("_n") > 2 * yes_cutoff) & (c("_r") > 1)) | ((c("decision") == "YES") & (c("_y") > yes_cutoff))
        h = h.withColumn("decision", F.when(cut, "NO").otherwise(c("decision"))).withColumn("score", F.when(cut, 0.0).otherwise(c("score"))).drop("_n", "_r", "_y")
    return h.filter("decision = 'YES'") if remove_no else h


def raw_hits(raw: DataFrame, segments: DataFrame, names: DataFrame, flen: float = 0.01) -> DataFrame:
    """Index hits (kwid, utt, first, last, cost) in recording time and under file names (utt, file)."""
    begin, end = F.round(c("first") * flen, 2), F.round(c("last") * flen, 2)
    h = raw.join(segments.select("utt", c("start").alias("_s")), "utt").join(names, "utt")
    return h.select("kwid", "file", F.round(begin + c("_s"), 2).alias("tbeg"), F.round(end - begin, 2).alias("dur"), F.exp(-c("cost")).alias("score"))


def alignment_quality(aligned: DataFrame, text: DataFrame, loss: float = 0.2) -> DataFrame:
    """Words (utt, pos, word) with low confidence beside ``<unk>``, also across a silence; utterances that lost too much failed."""
    w = Window.partitionBy("utt").orderBy("pos")
    p1, p2, n1, n2 = (F.lag("word", 1).over(w), F.lag("word", 2).over(w), F.lead("word", 1).over(w), F.lead("word", 2).over(w))
    low = (p1 == "<unk>") | ((p1 == "SIL") & (p2 == "<unk>")) | (n1 == "<unk>") | ((n1 == "SIL") & (n2 == "<unk>"))
    a = aligned.withColumn("low", F.coalesce(low, F.lit(False))).withColumn("_real", ~c("word").isin("<unk>", "SIL"))
    n = a.groupBy("utt").agg(F.count_if("_real").alias("got"), F.count_if(c("_real") & c("low")).alias("n_low"))
    return n.join(text.select("utt", F.size("words").alias("want")), "utt").withColumn("failed", c("got") < (1 - loss) * c("want"))


def oracle_error(nbest: DataFrame, ref: DataFrame) -> DataFrame:
    """Fewest word edits of an utterance's hypotheses (utt, hyp, words) against its reference."""
    return least_errors(side_by_side(ref, nbest))


def least_errors(both: DataFrame) -> DataFrame:
    """Fewest word edits of an utterance over its rows of texts side by side (utt, r, h)."""
    return error_rows(both).groupBy("utt").agg(F.min(c("s") + c("i") + c("d")).alias("err"))


def rescore(nbest: DataFrame, weight: float) -> DataFrame:
    """Best hypothesis after mixing in another model: graph + w * rnn + (1 - w) * (withlm - nolm)."""
    s = nbest.withColumn("cost", c("graph") + weight * c("rnn") + (1 - weight) * (c("withlm") - c("nolm")))
    return s.groupBy("utt").agg(F.min_by("hyp", F.struct("cost", "hyp")).alias("hyp"), F.min("cost").alias("cost"))
