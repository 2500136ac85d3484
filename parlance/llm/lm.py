"""Language-model scoring by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, distinct, give_back, id_remainder, store, table

#: Bytes of context at the deepest level of the trees; at least 3, at most 6 (a window fits in 56 bits).
DEPTH = 6
#: Bytes of coded text in a chunk of a task's documents, and in a block that is worked on at once.
CHUNK_BYTES, BLOCK_BYTES = 16 << 20, 1 << 20
#: Windows, or words, that all chunks together send to one part; every how many windows one is sampled.
PART_ROWS, SAMPLE = 250_000, 1024
LN2 = math.log(2)

# --- estimates

_SMALL = 1 << 16
#: log Gamma(k + 1/2) and log Gamma(k + 1) for small k, summed up from k = 0.
_HALF = np.concatenate([[0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_ONE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))])


def log_gamma(k: np.ndarray, more: float, small: np.ndarray) -> np.ndarray:
    """log Gamma(k + more): from a table, or by Stirling's series where k is large."""
    x = np.maximum(k, _SMALL) + more
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return np.where(k <= _SMALL, small[np.minimum(k, _SMALL).astype(np.int64)], series)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(n0, 0.5, _HALF) + log_gamma(n1, 0.5, _HALF) - math.log(math.pi) - log_gamma(n0 + n1, 1.0, _ONE)


class Nodes:
    """Nodes of one depth and one bit place: counts, log of the weighted probability, weight of stopping, own estimate of a one.

    ``below`` is the sum of the children's logs; at the deepest level there is none. A context that training never
    saw has counts of zero and adds nothing to its parent.
    """

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        le = kt(n0, n1)
        self.n0, self.n1 = n0, n1
        self.lw = le if below is None else np.logaddexp(le, below) - LN2
        self.stop = np.ones(len(n0)) if below is None else np.exp(le - LN2 - self.lw)
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        self.seen = n0 + n1 > 0

    def forget_counts(self) -> None:
        """Keep what predictions need."""
        self.n0 = self.n1 = self.lw = None


def bit_nodes(pair: np.ndarray, n: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted (context, byte) pairs: the node of each at bit place b, its first pair, and its counts of 0 and 1."""
    prefix = pair >> np.uint64(8 - b)
    new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
    node, first = np.cumsum(new, dtype=np.int32) - np.int32(1), np.flatnonzero(new)
    bit = (pair >> np.uint64(7 - b)) & np.uint64(1) == 1
    return node, first, np.bincount(node, np.where(bit, 0, n), len(first)), np.bincount(node, np.where(bit, n, 0), len(first))


class Trees:
    """Depths 3 to ``depth`` of the trees over sorted distinct windows with their counts in training texts.

    A window is an integer: the byte before, the one before that, ..., then the byte itself lowest. So the windows
    of a context, of any depth, are neighbours, and a shorter context is a longer one shifted. With ``answers``, what
    predictions need of every depth is kept; else only the sums for depth 2 are.
    """

    def __init__(self, win: np.ndarray, n: np.ndarray, depth: int, answers: bool):
        self.levels: dict[int, list[tuple[np.ndarray, Nodes]]] = {}  # of each bit place: the node of each pair, and the nodes
        self.at: dict[int, np.ndarray] = {depth: np.arange(len(win))}  # the pair of each window, by depth
        pair, lower = win, None
        for d in range(depth, 1, -1):
            if d < depth:
                short = (pair >> np.uint64(16)) << np.uint64(8) | pair & np.uint64(255)
                pair, up = np.unique(short, return_inverse=True)
                n = np.bincount(up, n, len(pair))
                self.at[d] = up[self.at[d + 1]]
            own = []
            for b in range(8):
                node, first, n0, n1 = bit_nodes(pair, n, b)
                below = None
                if d < depth:
                    _, child_first, child = lower[b]
                    below = np.bincount(node[up[child_first]], child.lw, len(first))
                if d == 2:  # unfinished: other parts may hold windows of the same two bytes
                    key = (pair[first] >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << b) | (pair[first] & np.uint64(255)) >> np.uint64(8 - b)
                    own.append((node, key, n0, n1, below))
                else:
                    own.append((node, first, Nodes(n0, n1, below)))
            if d == 2:
                self.two = own
            else:
                lower = own
                if answers:
                    self.levels[d] = [(node, x) for node, _, x in own]
            if d + 1 in self.levels:
                for _, x in self.levels[d + 1]:
                    x.forget_counts()

    def log_probabilities(self, keys: np.ndarray, alpha: np.ndarray, beta: np.ndarray, alone: np.ndarray, win: np.ndarray) -> np.ndarray:
        """log10 of each window's last byte given its context, mixed over all depths.

        A node mixes its estimate with the prediction of its child on the context's path, by the posterior weight of
        stopping; where training never saw the child's context, the mixture ends. Depths 0 to 2 are given for the
        nodes ``keys`` of depth 2: the probability of a one is alpha + beta * (that of depth 3), or ``alone``.
        """
        total = np.zeros(len(win))
        for b in range(8):
            p, below = np.full(len(win), 0.5), np.zeros(len(win), bool)
            for d in sorted(self.levels, reverse=True):
                node, x = self.levels[d][b]
                k = node[self.at[d]]
                mixed = np.where(below, x.stop[k] * x.one[k] + (1 - x.stop[k]) * p, x.one[k])
                p = np.where(x.seen[k], mixed, p)
                below |= x.seen[k]
            node, key, *_ = self.two[b]
            k = np.searchsorted(keys, key)[node[self.at[2]]]
            p = np.where(below, alpha[k] + beta[k] * p, alone[k])
            bit = (win >> np.uint64(7 - b)) & np.uint64(1) == 1
            total += np.log10(np.where(bit, p, 1 - p))
        return total


# --- windows and words of a chunk

def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def steps(win: np.ndarray) -> bytes:
    """Sorted windows as packed differences."""
    return packed(np.diff(win, prepend=np.uint64(0)))


def unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8"), dtype=np.uint64)


def coded(text: str | None) -> bytes:
    """Lower-cased (A-Z) words, each with a space after it, and a line feed as the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return b" ".join([*words, b"\n"])


def segments(body: bytes, depth: int) -> Iterator[bytes]:
    """A coded text as segments of at most about a block, cut after a space, each led by the ``depth`` bytes before it."""
    lead, at = b"\n" * depth, 0
    while at < len(body):
        end = len(body) if len(body) - at <= BLOCK_BYTES else body.rfind(b" ", at, at + BLOCK_BYTES) + 1 or body.find(b" ", at) + 1
        yield lead + body[at:end]
        lead, at = (lead + body[max(0, end - depth) : end])[-depth:], end


def block_windows(stream: bytes, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Windows of all positions of a block's segments but for the bytes that lead them."""
    x = np.frombuffer(stream, np.uint8).astype(np.uint64)
    win = x[depth:].copy()
    for k in range(1, depth + 1):
        win |= x[depth - k : len(x) - k] << np.uint64(8 * (depth + 1 - k))
    keep = np.ones(len(x), bool)
    keep[((np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)).ravel()] = False
    return win[keep[depth:]]


def block_words(stream: bytes, sizes: np.ndarray, depth: int) -> tuple[pa.Array, np.ndarray]:
    """The words of a block's segments, and how many each has."""
    ends = np.cumsum(sizes).tolist()
    texts = [stream[e - s + depth : e].rstrip(b" \n") or None for s, e in zip(sizes.tolist(), ends)]
    parts = pc.split_pattern(pa.array(texts, pa.binary()), b" ")
    return parts.flatten(), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their values."""
    if not len(key):
        return (key, *[v.astype(np.float64) for v in values])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first], *[np.add.reduceat(v[order], first, dtype=np.float64) for v in values])


class Vocabulary:
    """Words of a chunk in the order of their first places, block after block; only the distinct ones are held."""

    def __init__(self):
        self.words = pa.array([], pa.binary())

    def add(self, words: pa.Array) -> np.ndarray:
        """The number of each word of a block; new words are added."""
        block = words.dictionary_encode()
        known = pc.index_in(block.dictionary, value_set=self.words)
        new = pc.is_null(known).to_numpy(zero_copy_only=False)
        at = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        at[new] = len(self.words) + np.arange(new.sum())
        self.words = pa.concat_arrays([self.words, block.dictionary.filter(pa.array(new))])
        return at[block.indices.to_numpy()]


CHUNKS = "chunk long, kind int, n long, m long, a binary, b binary, c binary, sample array<long>"
TEXT, DOCS, WINDOWS, WORDS = range(4)


class Chunk:
    """Documents of one chunk, block by block; its rows, of four kinds, are read by the later steps.

    TEXT: a block's coded segments, their documents (numbers within the chunk) and sizes; m is the block's number.
    DOCS: ids, whether the id is null, whether held out; n counts those that train. WINDOWS: the chunk's n distinct
    windows and their counts in training texts. WORDS: the same for words; m is their number in training texts.
    """

    def __init__(self, number: int, depth: int):
        self.number, self.depth = number, depth
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.size = 0
        self.open: list[tuple[int, bytes]] = []
        self.open_size = 0
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []
        self.blocks, self.vocabulary, self.trained = 0, Vocabulary(), np.zeros(0, np.int64)

    def row(self, kind: int, n: int, m: int, a: bytes, b: bytes, c: bytes = b"", sample: list | None = None) -> pa.RecordBatch:
        cols = [[self.number], [kind], [n], [m], [a], [b], [c], [sample or []]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], [x.split()[0] for x in CHUNKS.split(", ")])

    def add(self, doc: int | None, held: bool, text: str | None) -> Iterator[pa.RecordBatch]:
        for seg in segments(coded(text), self.depth):
            self.open.append((len(self.ids), seg))
            self.open_size += len(seg)
            if self.open_size >= BLOCK_BYTES:
                yield self.close_block([*self.held, held])
        self.ids.append(doc)
        self.held.append(held)

    def close_block(self, held: list[bool]) -> pa.RecordBatch:
        docs = np.array([d for d, _ in self.open], np.int32)
        sizes = np.array([len(s) for _, s in self.open], np.int32)
        stream = b"".join(s for _, s in self.open)
        self.size, self.open, self.open_size = self.size + len(stream), [], 0
        apart = np.array(held)[docs]
        win = block_windows(stream, sizes, self.depth) << np.uint64(1) | np.repeat(apart, sizes - self.depth)
        key, n = np.unique(win, return_counts=True)
        win, n = summed(key >> np.uint64(1), np.where(key & np.uint64(1) == 1, 0, n))
        self.windows.append((win, n.astype(np.uint32)))
        if len(self.windows) > 3:
            self.merge()
        words, count = block_words(stream, sizes, self.depth)
        at = self.vocabulary.add(words)[np.repeat(~apart, count)]
        more = np.bincount(at, minlength=len(self.vocabulary.words))
        more[: len(self.trained)] += self.trained
        self.trained, self.blocks = more, self.blocks + 1
        return self.row(TEXT, len(sizes), self.blocks, zstandard.ZstdCompressor(level=3).compress(stream), docs.tobytes(), sizes.tobytes())

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        win, n = summed(*(np.concatenate(x) for x in zip(*self.windows)))
        self.windows = [(win, n.astype(np.uint32))]
        return self.windows[0]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self.close_block(self.held)
        null = np.array([i is None for i in self.ids])
        yield self.row(DOCS, int((~np.array(self.held)).sum()), 0, np.array([i or 0 for i in self.ids], "<i8").tobytes(), null.tobytes(), np.array(self.held).tobytes())
        win, n = self.merge()
        yield self.row(WINDOWS, len(win), 0, steps(win), packed(n.astype("<u4")), b"", (win[::SAMPLE] >> np.uint64(8 * (self.depth - 2))).astype(np.int64).tolist())
        train = self.trained.astype("<u4")
        yield self.row(WORDS, len(train), int(train.sum()), zstandard.ZstdCompressor(level=1).compress(b"\n".join(self.vocabulary.words.to_pylist())), packed(train))


def chunked(docs: DataFrame, depth: int) -> DataFrame:
    """One pass over the texts (doc_id, held_out, text), in the rows of :class:`Chunk`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        chunk = Chunk(number, depth)
        for b in batches:
            for doc, held, text in zip(*b.columns):
                yield from chunk.add(doc.as_py(), held.as_py(), text.as_py())
                if chunk.size >= CHUNK_BYTES:
                    yield from chunk.close()
                    number += 1
                    chunk = Chunk(number, depth)
                    give_back()
        if chunk.ids:
            yield from chunk.close()

    return docs.mapInArrow(run, CHUNKS)


# --- exchanges: chunks ask, parts answer

def split_windows(rows: DataFrame, cuts: np.ndarray, depth: int) -> DataFrame:
    """(part, chunk, a, b): each chunk's windows and counts, by ranges of their last three context bytes."""
    edges = cuts.astype(np.uint64) << np.uint64(8 * (depth - 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, wins, counts in zip(*(c.to_pylist() for c in b.columns)):
                win, n = unsteps(wins), unpacked(counts, "<u4")
                at = [0, *np.searchsorted(win, edges).tolist(), len(win)]
                own = [(k, i, j) for k, (i, j) in enumerate(zip(at, at[1:])) if i < j]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([k for k, _, _ in own], pa.int32()), "chunk": pa.array([chunk] * len(own), pa.int64()),
                    "a": [steps(win[i:j]) for _, i, j in own], "b": [packed(n[i:j]) for _, i, j in own],
                })

    return rows.select("chunk", "a", "b").mapInArrow(run, "part int, chunk long, a binary, b binary")


def merged(asked: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Windows of each asking chunk, and the distinct windows of all with their counts."""
    each = [unsteps(x.as_py()) for x in asked["a"]]
    counts = np.concatenate([unpacked(x.as_py(), "<u4") for x in asked["b"]])
    return each, *summed(np.concatenate(each), counts)


TOPS = "part int, first int, key binary, n0 binary, n1 binary, lw binary"


def part_tops(asked: DataFrame, depth: int) -> DataFrame:
    """What each part adds to the nodes of depth 2, in a row for each last byte of the context."""

    def run(asked: pa.Table) -> pa.Table:
        give_back()  # of the part before
        _, win, n = merged(asked)
        key, n0, n1, lw = (np.concatenate(x) for x in list(zip(*Trees(win, n, depth, False).two))[1:])
        order = np.argsort(key, kind="stable")
        key, n0, n1, lw = key[order], n0[order], n1[order], lw[order]
        first = (key >> np.uint64(16)).astype(np.int64)
        at = [*np.flatnonzero(np.diff(first, prepend=-1)).tolist(), len(key)]
        own = list(zip(at, at[1:]))
        cols = [pa.array([asked["part"][0].as_py()] * len(own), pa.int32()), pa.array(first[at[:-1]], pa.int32())]
        cols += [pa.array([x[i:j].tobytes() for i, j in own], pa.binary()) for x in (key, n0, n1, lw)]
        return pa.Table.from_arrays(cols, [x.split()[0] for x in TOPS.split(", ")])

    return asked.groupBy("part").applyInArrow(run, TOPS)


def middle(tops: pa.Table) -> tuple[np.ndarray, Nodes, Nodes]:
    """Nodes of depth 2 (with their keys) and 1 (by bit prefix) for one last byte of the context."""
    key, n0, n1, lw = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in tops[c]]) for c, kind in (("key", "<u8"), ("n0", "<f8"), ("n1", "<f8"), ("lw", "<f8")))
    key, n0, n1, lw = summed(key, n0, n1, lw)
    two, u = Nodes(n0, n1, lw), (key & np.uint64(255)).astype(np.int64)
    return key, two, Nodes(np.bincount(u, n0, 256), np.bincount(u, n1, 256), np.bincount(u, two.lw, 256))


def root(tops: DataFrame) -> Nodes:
    """Nodes of depth 0 by bit prefix; at most 256 rows of 256 come to the driver."""

    def run(own: pa.Table) -> pa.Table:
        _, _, one = middle(own)
        return pa.table({"n0": [one.n0.tobytes()], "n1": [one.n1.tobytes()], "lw": [one.lw.tobytes()]})

    got = tops.groupBy("first").applyInArrow(run, "n0 binary, n1 binary, lw binary").collect()
    add = [np.sum([np.frombuffer(r[c], "<f8") for r in sorted(got)], axis=0) if got else np.zeros(256) for c in ("n0", "n1", "lw")]
    return Nodes(*add)


BACK = "part int, first int, key binary, alpha binary, beta binary, alone binary"


def told_tops(tops: DataFrame, zero: Nodes) -> DataFrame:
    """For each part, depths 0 to 2 of the mixture at the nodes of depth 2 that it has windows under."""

    def run(own: pa.Table) -> pa.Table:
        key, two, one = middle(own)
        u = (key & np.uint64(255)).astype(np.int64)
        top = np.where(zero.seen, zero.stop * zero.one, 0)
        given = top + (1 - zero.stop) * one.stop * one.one
        rest = (1 - zero.stop) * (1 - one.stop)
        alpha, beta = given[u] + rest[u] * two.stop * two.one, rest[u] * (1 - two.stop)
        until = np.where(one.seen, top + (1 - zero.stop) * one.one, np.where(zero.seen, zero.one, 0.5))
        alone = np.where(two.seen, given[u] + rest[u] * two.one, until[u])
        rows = []
        for part, first, mine in zip(own["part"].to_pylist(), own["first"].to_pylist(), own["key"].to_pylist()):
            k = np.searchsorted(key, np.frombuffer(mine, "<u8"))
            rows.append((part, first, mine, alpha[k].tobytes(), beta[k].tobytes(), alone[k].tobytes()))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in BACK.split(", ")])

    return tops.groupBy("first").applyInArrow(run, BACK)


ANSWERS = "chunk long, kind int, part int, told binary, distinct long"


def window_answers(asked: DataFrame, back: DataFrame, depth: int) -> DataFrame:
    """log10 probabilities (float32) of each chunk's windows of each part, in the order in which they were asked."""

    def run(asked: pa.Table, back: pa.Table) -> pa.Table:
        give_back()  # of the part before
        each, win, n = merged(asked)
        order = np.argsort(back["first"].to_numpy())
        keys, *mix = (np.concatenate([np.frombuffer(back[c][int(i)].as_py(), kind) for i in order]) for c, kind in (("key", "<u8"), ("alpha", "<f8"), ("beta", "<f8"), ("alone", "<f8")))
        lp = Trees(win, n, depth, True).log_probabilities(keys, *mix, win).astype("<f4")
        return answer_rows(asked["chunk"], WINDOWS, asked["part"][0].as_py(), [lp[np.searchsorted(win, own)].tobytes() for own in each], 0)

    return asked.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(run, ANSWERS)


def answer_rows(chunk: pa.ChunkedArray, kind: int, part: int, told: list[bytes], distinct: int) -> pa.Table:
    """``distinct`` is carried by the first row."""
    n = len(told)
    cols = [chunk.combine_chunks(), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(told, pa.binary()), pa.array([distinct] + [0] * (n - 1), pa.int64())]
    return pa.Table.from_arrays(cols, [x.split()[0] for x in ANSWERS.split(", ")])


def word_parts(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts


def word_answers(rows: DataFrame, parts: int) -> DataFrame:
    """Training counts (uint32) of each chunk's words of each part, in the order of the chunk's words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, joined, counts in zip(*(c.to_pylist() for c in b.columns)):
                words, n = zstandard.ZstdDecompressor().decompress(joined).split(b"\n"), unpacked(counts, "<u4")
                if not len(n):
                    continue
                part = word_parts(words, parts)
                own = [(int(p), np.flatnonzero(part == p)) for p in np.unique(part)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for p, _ in own], pa.int32()), "chunk": pa.array([chunk] * len(own), pa.int64()),
                    "a": [zstandard.ZstdCompressor(level=1).compress(b"\n".join([words[i] for i in k.tolist()])) for _, k in own], "b": [packed(n[k]) for _, k in own],
                })

    def add(asked: pa.Table) -> pa.Table:
        each = [pa.array(zstandard.ZstdDecompressor().decompress(x.as_py()).split(b"\n"), pa.binary()) for x in asked["a"]]
        which = pa.chunked_array(each).combine_chunks().dictionary_encode()
        at = which.indices.to_numpy()
        total = np.bincount(at, np.concatenate([unpacked(x.as_py(), "<u4") for x in asked["b"]]), len(which.dictionary))
        ends = np.cumsum([0, *map(len, each)])
        told = [packed(total[at[i:j]].astype("<i8")) for i, j in zip(ends[:-1], ends[1:])]
        return answer_rows(asked["chunk"], WORDS, asked["part"][0].as_py(), told, int((total > 0).sum()))

    asked = rows.select("chunk", "a", "b").mapInArrow(split, "part int, chunk long, a binary, b binary")
    return asked.groupBy("part").applyInArrow(add, ANSWERS)


# --- scores

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def chunk_scores(rows: pa.Table, told: pa.Table, depth: int, n: int, v: int, ends: int, parts: int) -> pa.Table:
    """Scores of a chunk's documents, from its text and the answers to its windows and words."""
    give_back()  # of the chunk before
    kind = rows["kind"].to_numpy()
    ids, null, held = (rows[c][int(np.flatnonzero(kind == DOCS)[0])].as_py() for c in ("a", "b", "c"))
    ids, null, held = np.frombuffer(ids, "<i8"), np.frombuffer(null, bool), np.frombuffer(held, bool)
    docs, texts = len(ids), np.flatnonzero(kind == TEXT)
    texts = texts[np.argsort(rows["m"].to_numpy()[texts])].tolist()  # the words are numbered block after block

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """Of each block: its windows and their documents' numbers, its words and theirs. They are made twice, not held."""
        for i in texts:
            stream = zstandard.ZstdDecompressor().decompress(rows["a"][i].as_py())
            owner, sizes = np.frombuffer(rows["b"][i].as_py(), np.int32), np.frombuffer(rows["c"][i].as_py(), np.int32)
            text, count = block_words(stream, sizes, depth)
            yield block_windows(stream, sizes, depth), np.repeat(owner, sizes - depth), text, np.repeat(owner, count)

    vocabulary, every = Vocabulary(), np.zeros(0, np.uint64)
    for win, _, text, _ in blocks():
        every = distinct(np.concatenate([every, distinct(win)]))
        vocabulary.add(text)
    told = list(zip(told["kind"].to_pylist(), told["part"].to_pylist(), told["told"].to_pylist()))
    lp = np.concatenate([np.frombuffer(x, "<f4") for _, _, x in sorted(t for t in told if t[0] == WINDOWS)])
    part, c = word_parts(vocabulary.words.to_pylist(), parts), np.zeros(len(vocabulary.words), np.int64)
    for k, p, x in told:
        if k == WORDS:
            c[part == p] = unpacked(x, "<i8")

    score, size, tokens = np.zeros(docs), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    base, known = np.full(docs, math.log10((ends + 1) / (n + v + 1))), np.full(docs, int(ends > 0))
    cost = np.log10((c + 1) / (n + v + 1))
    for win, owner, text, speaker in blocks():
        order = np.argsort(win)
        own, count = np.unique(win[order], return_counts=True)
        at = np.empty(len(order))
        at[order] = np.repeat(lp[np.searchsorted(every, own)], count)
        score += np.bincount(owner, at, docs)
        size += np.bincount(owner, minlength=docs)
        word = vocabulary.add(text)
        base += np.bincount(speaker, cost[word], docs)
        known += np.bincount(speaker[c[word] > 0], minlength=docs)
        tokens += np.bincount(speaker, minlength=docs)
    cols = [
        pa.array(ids, pa.int64(), mask=null), pa.array(held), pa.array(tokens + 1), pa.array(known),
        pa.array(np.full(docs, n)), pa.array(base), pa.array(score), pa.array(-score / math.log10(2) / size),
    ]
    return pa.Table.from_arrays(cols, [x.split()[0] for x in SCORES.split(", ")])


def score_texts(docs: DataFrame, *, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by context-tree weighting, and by add-one word counts as a base.

    A text is its lower-cased (A-Z) words and one end, coded as bytes: each word with a space after it, then a line
    feed. Each byte is coded bit by bit; a bit's context is the bits before it in its byte and up to ``depth`` bytes
    before that, over word boundaries (line feeds before the start). Every binary node of the context trees holds a
    Krichevsky-Trofimov estimate from all positions of all training texts, and the estimates of all depths are
    mixed by the trees' weights. ``bits_per_byte`` is the code length of the text over its coded bytes. The trees
    are not updated while scoring. Training texts are those with crc32(doc_id as text) mod 7 not 2.

    Positions never leave their task: a task counts the distinct windows (context and byte) of a chunk of its
    documents and asks for their probabilities. Windows are dealt to parts by ranges of their last three context
    bytes, so a part holds whole subtrees below depth 3; what parts add to depth 2 meets by the last byte, and
    depth 0 (255 nodes) on the driver. Parts grow in number with what all chunks ask, so their size stays the same.

    Null and empty texts are one end; a null doc_id trains; repeated rows and rows of one id train and are scored
    each; a very long text is worked on in blocks; an empty table gives an empty result; without training texts
    every bit costs one bit. Only the two named columns are read, so other columns may have any name.
    """
    if not 3 <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(id_remainder(F.col(id_col).cast("long"), 7) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    rows = store(chunked(cols, depth), "chunks")
    of = {k: rows.filter(F.col("kind") == k) for k in (TEXT, DOCS, WINDOWS, WORDS)}
    totals = {r["kind"]: (r["n"], r["m"]) for r in rows.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()}  # a row a kind
    parts, word_part_count = (max(1, -(-totals.get(k, (0, 0))[0] // PART_ROWS)) for k in (WINDOWS, WORDS))

    cuts = np.zeros(0, np.int64)
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = np.unique(of[WINDOWS].select(F.explode("sample").alias("x")).agg(F.percentile_approx("x", shares, 100 * parts)).first()[0])
    asked = split_windows(of[WINDOWS], cuts, depth)
    tops = store(part_tops(asked, depth), "tops")
    back = told_tops(tops, root(tops))
    answers = store(window_answers(asked, back, depth).unionByName(word_answers(of[WORDS], word_part_count)), "answers")

    ends = totals.get(DOCS, (0, 0))[0]
    v = (answers.agg(F.sum("distinct")).first()[0] or 0) + int(ends > 0)
    n = ends + totals.get(WORDS, (0, 0))[1]

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        return chunk_scores(own, told, depth, n, v, ends, word_part_count)

    texts = rows.filter(F.col("kind").isin(TEXT, DOCS)).select("chunk", "kind", "m", "a", "b", "c")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORES)


def op8_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
