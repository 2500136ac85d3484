"""Alignment of two tokenizers' tokens by byte offsets: an associative fragment monoid, and links counted over the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import give_back, join_checked, sliced, store, table
from .tokens import BYTE_CHARS, MARK, Encoder, encoder, gathered, public_path, split_numbered

#: Bytes of a text beyond which it is cut into fragments that Spark reduces as a tree, and of such a fragment.
CHUNK_BYTES = 32 << 10
#: Fragments that one step of the tree composes.
FAN_IN = 8
#: Bytes of text that a task aligns at once.
SLICE_BYTES = 1 << 20
#: Bytes of text whose documents ask for counts together.
BLOCK_BYTES = 8 << 20
#: A group of more links than this has its repeated ids counted before they are paired.
WIDE = 4096


class PieceEncoder(Encoder):
    """Ids of parts of texts by a sentencepiece model that adds a space in front of a text.

    Where no piece of the vocabulary holds a space after another character, or a character after a letter that is
    neither letter nor space, merges cross neither the start of a run of spaces, nor a line feed, nor the place
    between a letter and a mark; texts may be cut there and each distinct part is encoded once. A vocabulary that
    is not so gets whole texts (``cuts`` false).
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        merged = [p for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) for p in [self.model.id_to_piece(i)]]
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p or any(x.isalpha() and not y.isalpha() and y != "▁" for x, y in zip(p, p[1:])) for p in merged)
        self.young, self.old, self.keep_space = {"": b""}, {}, False
        self.head = len(self.model.encode("\n"))

    def _learn(self, pieces: list[str]) -> None:
        """Encode new parts. One without a space before it goes in after a line feed, whose ids are dropped."""
        spaced = [x[0] == " " for x in pieces]
        found = self.model.encode([x[1:] if s else "\n" + x for x, s in zip(pieces, spaced)], num_threads=1)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        starts = ends - np.fromiter(map(len, found), np.int64, len(found)) + np.where(spaced, 0, self.head)
        raw = np.fromiter(chain.from_iterable(found), "<u2", int(ends[-1])).tobytes()
        self.young.update((x, raw[i:j]) for x, i, j in zip(pieces, (2 * starts).tolist(), (2 * ends).tolist()))


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


class Parts(NamedTuple):
    """Distinct parts of some texts, each with its ids of both kinds, and the parts of each text."""

    words: list[bytes]
    a: list[bytes]
    b: list[bytes]
    flat: np.ndarray
    bound: np.ndarray


def encoded_parts(texts: pa.Array, one: Encoder, two: PieceEncoder) -> Parts:
    """Cut texts, each with a space in front, where neither tokenizer merges; texts with other white space are one part."""
    spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
    odd = pc.match_substring_regex(spaced, one.odd) if two.cuts else pc.not_equal(texts, "")
    whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    cut = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", spaced), " ", "\0 "), "\n", "\0\n\0")
    pieces, which, bound = split_numbered(cut)
    parts, own, edge = split_numbered(pc.replace_substring_regex(pieces, MARK, "\\1\0\\2"))
    flat, bound = gathered(own, np.diff(edge), which, bound)
    words = parts.to_pylist()
    a, b = one._ids_of(words), two._ids_of(words)
    flat[bound[whole]] = len(words) + np.arange(len(whole))  # such a text was cut as an empty one: one part
    for t in spaced.take(pa.array(whole)).to_pylist():
        words.append(t)
        a.append(np.array(one.tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes())
        b.append(np.array(two.model.encode(t[1:], num_threads=1), "<u2").tobytes())
    return Parts([w.encode("utf-8", "surrogatepass") for w in words], a, b, flat, bound)


class Spelling:
    """Bytes of a vocabulary's entries, for the bytes of many ids at once."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def byte_level_spelling(path: str) -> Spelling:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    back = {chr(c): b for b, c in BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in BYTE_CHARS}
    entries = [b""] * tok.get_vocab_size()
    for text, i in tok.get_vocab().items():
        entries[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
    return Spelling(entries)


@lru_cache(maxsize=2)
def piece_spelling(path: str) -> Spelling:
    model = piece_encoder(path).model

    def spelled(p: str) -> bytes:
        plain_byte = len(p) == 6 and p.startswith("<0x") and p.endswith(">")
        return bytes([int(p[3:5], 16)]) if plain_byte else p.replace("▁", " ").encode()

    return Spelling([spelled(model.id_to_piece(i)) for i in range(model.get_piece_size())])


# --- fragments

class Fragment(NamedTuple):
    """What a byte range of a text knows of its groups. Ids are little-endian uint16 bytes, counts uint32 bytes.

    A group ends where an A and a B token both end. ``cut`` says whether the range holds such an end. If so, the
    open prefix is what lies before and through the first, the closed groups are those between ends in the range, with
    their numbers of tokens, and the open suffix is what follows the last; else all is open prefix.
    """

    cut: bool
    head_a: bytes = b""
    head_b: bytes = b""
    a: bytes = b""
    b: bytes = b""
    n_a: bytes = b""
    n_b: bytes = b""
    tail_a: bytes = b""
    tail_b: bytes = b""


#: The neutral element: a range without tokens.
EMPTY = Fragment(False)


def _count(ids: bytes) -> bytes:
    return np.array([len(ids) // 2], "<u4").tobytes()


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two ranges side by side; associative, with EMPTY as the neutral element."""
    if not y.cut:
        if not x.cut:
            return Fragment(False, x.head_a + y.head_a, x.head_b + y.head_b)
        return x._replace(tail_a=x.tail_a + y.head_a, tail_b=x.tail_b + y.head_b)
    if not x.cut:
        return y._replace(head_a=x.head_a + y.head_a, head_b=x.head_b + y.head_b)
    a, b = x.tail_a + y.head_a, x.tail_b + y.head_b  # the group over the border
    return Fragment(True, x.head_a, x.head_b, x.a + a + y.a, x.b + b + y.b, x.n_a + _count(a) + y.n_a, x.n_b + _count(b) + y.n_b, y.tail_a, y.tail_b)


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token ends where one of the other tokenizer's does. Ends rise strictly."""
    def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(y):
            return np.zeros(len(x), bool)
        return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x

    return among(a_ends, b_ends), among(b_ends, a_ends)


def tokens_a_group(shared: np.ndarray) -> np.ndarray:
    """Numbers of tokens of the groups that close, in order, from the tokens' flags."""
    return np.diff(np.concatenate([[-1], np.flatnonzero(shared)]))


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in a byte range."""
    end_a, end_b = shared_ends(a_ends, b_ends)
    a, b = a.astype("<u2"), b.astype("<u2")
    if not end_a.any():
        return Fragment(False, a.tobytes(), b.tobytes())
    at_a, at_b = np.flatnonzero(end_a), np.flatnonzero(end_b)
    (a0, a1), (b0, b1) = (at_a[[0, -1]] + 1).tolist(), (at_b[[0, -1]] + 1).tolist()
    return Fragment(
        True, a[:a0].tobytes(), b[:b0].tobytes(), a[a0:a1].tobytes(), b[b0:b1].tobytes(), np.diff(at_a).astype("<u4").tobytes(), np.diff(at_b).astype("<u4").tobytes(),
        a[a1:].tobytes(), b[b1:].tobytes(),
    )


def groups_of(x: Fragment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B and the groups' numbers of tokens, of a fragment that is a whole text."""
    if not x.cut or x.tail_a or x.tail_b:
        raise ValueError("the fragment does not end where both tokenizers do")
    whole = compose(Fragment(True), x)  # a text starts as if after a shared end
    return tuple(np.frombuffer(v, kind) for v, kind in ((whole.a, "<u2"), (whole.b, "<u2"), (whole.n_a, "<u4"), (whole.n_b, "<u4")))


# --- what is kept of a text

@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every 16-bit id, padded to six bytes, and how many there are."""
    size = np.array([len(str(i)) for i in range(1 << 16)])
    return np.frombuffer(b"".join(str(i).encode().ljust(6) for i in range(1 << 16)), np.uint8).reshape(-1, 6), size


def group_text(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: the bytes of all groups, and where each group's end."""
    n = np.stack([n_a, n_b], 1).astype(np.int64)
    ends = np.cumsum(n.ravel()).reshape(-1, 2)  # tokens in the order of the text: a group's A, then its B
    order = np.empty(len(a) + len(b), np.int64)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(n[:, 1]) - n[:, 1], n[:, 0])
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(n[:, 0]), n[:, 1])
    order[at_a], order[at_b] = a, b
    digits, size = _digits()
    mark = np.full(len(order), ord(","), np.uint8)
    mark[ends[:, 0] - 1], mark[ends[:, 1] - 1] = ord("|"), ord(";")
    shown, length = digits[order].copy(), size[order]
    shown[np.arange(len(order)), length] = mark
    return shown[np.arange(6) <= length[:, None]], np.cumsum(length + 1)[ends[:, 1] - 1] if len(n) else np.zeros(0, np.int64)


def id_pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text << 32 | A id << 16 | B id) of the groups, sorted, and the links of each. ``text`` numbers the groups' texts."""
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    first_a, first_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    slim = np.flatnonzero(links <= WIDE)
    count = links[slim]
    group = np.repeat(slim, count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    one = a[first_a[group] + within // n_b[group]].astype(np.int64)
    keys, times = [(text[group] << 32) | (one << 16) | b[first_b[group] + within % n_b[group]]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(links > WIDE).tolist():
        ids_a, of_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, of_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        keys.append(((int(text[g]) << 32) | (ids_a.astype(np.int64)[:, None] << 16) | ids_b.astype(np.int64)).ravel())
        times.append((of_a[:, None] * of_b).ravel())
    key, time = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, time = key[order], time[order]
    if not len(key):
        return key, time
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(time, start)


def sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums of whole numbers between bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bound[1:]] - total[bound[:-1]]


def part_ids(raw: list[bytes], ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts end to end and how many each has; none of those that are not ``ok``."""
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    ids = np.frombuffer(b"".join(raw), "<u2").astype(np.int64)
    return (ids, size) if ok is None or ok.all() else (ids[np.repeat(ok, size)], size * ok)


def spelled_right(words: list[bytes], raw: list[bytes], spelling: Spelling) -> np.ndarray:
    """Whether the bytes of each part's ids are the part."""
    ids, size = part_ids(raw)
    want = np.fromiter(map(len, words), np.int64, len(words))
    ok = sums(spelling.size[ids], np.concatenate([[0], np.cumsum(size)])) == want
    got = spelling.bytes_of(part_ids(raw, ok)[0])
    wrong = np.flatnonzero(got != np.frombuffer(b"".join(w for w, k in zip(words, ok.tolist()) if k), np.uint8))
    ok[np.searchsorted(np.cumsum(want * ok), wrong, side="right")] = False
    return ok


class Summed(NamedTuple):
    """Groups of parts: numbers of A and B tokens, groups and links, group texts (each group ends in a semicolon), and
    the distinct id pairs of all parts in one array each, with how many a part has."""

    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    text: list[bytes]
    pairs: np.ndarray
    times: np.ndarray
    n_pairs: np.ndarray


def summed(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, part: np.ndarray, parts: int) -> Summed:
    """From the ids of groups in order, their numbers of tokens and the part of each group."""
    bound = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    shown, ends = group_text(a, b, n_a, n_b)
    raw, cuts = shown.tobytes(), np.concatenate([[0], ends])[bound].tolist()
    keys, times = id_pairs(a, b, n_a, n_b, part)
    n_pairs = np.diff(np.searchsorted(keys, np.arange(parts + 1, dtype=np.int64) << 32))
    return Summed(
        sums(n_a, bound), sums(n_b, bound), np.diff(bound), sums(n_a.astype(np.int64) * n_b, bound), [raw[i:j] for i, j in zip(cuts, cuts[1:])],
        keys & 0xFFFFFFFF, times, n_pairs,
    )


def of_texts(s: Summed, flat: np.ndarray, bound: np.ndarray) -> list:
    """Columns of OWN for texts from their parts, which lie between bounds in ``flat``."""
    n = len(bound) - 1
    parts, texts = flat.tolist(), s.text
    joined = [b"".join([texts[k] for k in parts[i:j]]) for i, j in zip(bound[:-1].tolist(), bound[1:].tolist())]
    keys, at = gathered(s.pairs, s.n_pairs, flat, bound)
    times, _ = gathered(s.times, s.n_pairs, flat, bound)
    keys = keys | (np.repeat(np.arange(n, dtype=np.int64), np.diff(at)) << 32)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, times = keys[first], np.add.reduceat(times, first) if len(first) else times
    ends = (4 * np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << 32)).tolist()
    raw, raw_times = (keys & 0xFFFFFFFF).astype("<u4").tobytes(), times.astype("<u4").tobytes()
    return [
        *(sums(v[flat], bound) for v in (s.n_a, s.n_b, s.groups, s.links)), [hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in joined],
        [raw[i:j] for i, j in zip(ends, ends[1:])], [raw_times[i:j] for i, j in zip(ends, ends[1:])],
    ]


OWN = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
HEAD = "doc_id long, row long, block long"
PIECES = "chunk int, a binary, a_ends binary, b binary, b_ends binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(", ")])


def aligned(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str, text_col: str, chunk_bytes: int, block_bytes: int) -> DataFrame:
    """First pass: finished rows of texts of up to ``chunk_bytes``, and of longer ones the tokens of each byte range."""
    schema = arrow_schema(f"{HEAD}, {OWN}, {PIECES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = encoder(public_path(vocabulary_a), True, True), piece_encoder(public_path(vocabulary_b))
        spell_a, spell_b = byte_level_spelling(public_path(vocabulary_a)), piece_spelling(public_path(vocabulary_b))
        part, row, seen = TaskContext.get().partitionId() << 33, 0, 0
        for batch in sliced(batches, 1, SLICE_BYTES):
            give_back()
            texts = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            rows = part + row + np.arange(len(size))
            blocks = part + (seen + np.cumsum(size)) // block_bytes
            row, seen = row + len(size), seen + int(size.sum())

            # every distinct part is aligned once; a part starts and ends where both tokenizers do
            p = encoded_parts(texts, one, two)
            ok = spelled_right(p.words, p.a, spell_a) & spelled_right(p.words, p.b, spell_b)
            (a, _), (b, _) = part_ids(p.a, ok), part_ids(p.b, ok)
            ends = np.cumsum(spell_a.size[a])
            end_a, end_b = shared_ends(ends, np.cumsum(spell_b.size[b]))
            places = np.cumsum(np.fromiter(map(len, p.words), np.int64, len(p.words)) * ok)
            known = summed(a, b, tokens_a_group(end_a), tokens_a_group(end_b), np.searchsorted(places, ends[end_a]), len(ok))

            right = sums(~ok[p.flat], p.bound) == 0
            far = right & (size >= chunk_bytes)
            done = np.flatnonzero(~far)
            parts = np.diff(p.bound)
            flat, _ = gathered(p.flat, parts, done[right[done]], np.zeros(1, np.int64))
            bound = np.concatenate([[0], np.cumsum((parts * right)[done])])  # a text with a wrong part has none
            if len(done):
                cols = [batch.column(0).take(pa.array(done)), pa.array(rows[done]), pa.array(blocks[done])]
                cols += [pa.array(v, f.type) for v, f in zip(of_texts(known, flat, bound), list(schema)[3:10])]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(done), f.type) for f in list(schema)[10:])], schema=schema)
            for i in np.flatnonzero(far).tolist():
                out, own = [], p.flat[p.bound[i] : p.bound[i + 1]].tolist()
                for raw, spell in ((p.a, spell_a), (p.b, spell_b)):
                    ids = np.frombuffer(b"".join([raw[k] for k in own]), "<u2")
                    ends = np.cumsum(spell.size[ids.astype(np.int64)])
                    at = np.searchsorted(ends, np.arange(0, size[i] + 1 + chunk_bytes, chunk_bytes), side="right").tolist()
                    out += [[ids[x:y].tobytes() for x, y in zip(at, at[1:])], [ends[x:y].astype("<i8").tobytes() for x, y in zip(at, at[1:])]]
                n = len(out[0])
                cols = [batch.column(0).take(pa.array([i] * n)), pa.array([int(rows[i])] * n), pa.array([-1 - int(rows[i])] * n)]
                cols += [pa.nulls(n, f.type) for f in list(schema)[3:10]] + [pa.array(range(n), pa.int32())] + [pa.array(v, pa.binary()) for v in out]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return cols.mapInArrow(run, f"{HEAD}, {OWN}, {PIECES}")


FRAGMENT = "cut boolean, head_a binary, head_b binary, a binary, b binary, n_a binary, n_b binary, tail_a binary, tail_b binary"


def composed(pieces: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Whole texts from their ranges' tokens: a fragment of each range, then rounds in which ``fan_in`` neighbours become one.

    A stage has one step in Python, so an executor has no more workers than cores.
    """
    keyed = arrow_schema(f"{HEAD}, chunk int, {FRAGMENT}")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, a_ends, b_, b_ends in zip(*(b.column(i).to_pylist() for i in range(4, 8))):
                out.append(fragment(np.frombuffer(a, "<u2"), np.frombuffer(a_ends, "<i8"), np.frombuffer(b_, "<u2"), np.frombuffer(b_ends, "<i8")))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(v, f.type) for v, f in zip(zip(*out) if out else [[]] * 9, list(keyed)[4:]))], schema=keyed)

    def total(t: pa.Table) -> tuple[list, Fragment]:
        """The first row's ids and the composition of all fragments of a group, in order."""
        t = t.sort_by("chunk")
        out = EMPTY
        for x in zip(*(t.column(f.name).to_pylist() for f in list(keyed)[4:])):
            out = compose(out, Fragment(*x))
        return [c[0].as_py() for c in t.columns[:4]], out

    def fold(t: pa.Table) -> pa.Table:
        (*at, chunk), x = total(t)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*at, chunk // fan_in, *x], keyed)], schema=keyed)

    whole = arrow_schema(f"{HEAD}, {OWN}")

    def finish(t: pa.Table) -> pa.Table:
        (*at, _), x = total(t)
        a, b, n_a, n_b = (v.astype(np.int64) for v in groups_of(x))
        own = of_texts(summed(a, b, n_a, n_b, np.zeros(len(n_a), np.int64), 1), np.zeros(1, np.int64), np.array([0, 1]))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip([*([v] for v in at), *own], whole)], schema=whole)

    highest = pieces.agg(F.max("chunk")).first()[0]
    spread = pieces.select("doc_id", "row", "block", "chunk", "a", "a_ends", "b", "b_ends").repartition(F.col("row"), F.expr(f"chunk div {fan_in}"))
    level = spread.mapInArrow(start, f"{HEAD}, chunk int, {FRAGMENT}")
    while highest >= fan_in:
        level = level.groupBy("row", F.expr(f"chunk div {fan_in}")).applyInArrow(fold, f"{HEAD}, chunk int, {FRAGMENT}")
        highest //= fan_in
    return level.groupBy("row").applyInArrow(finish, f"{HEAD}, {OWN}")  # fan_in rows at most


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct id pairs of each block with their documents (block, pair, k), and over all (pair, n, best).

    ``best`` says that n is the highest of the pair's A id. A pair is one row a block, so the pairs that all documents
    share are no heavier than others.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            block = b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else [0]
            raw = b.column(1).to_pylist()
            for i, j in zip(edges[:-1], edges[1:]):
                keys = np.sort(np.frombuffer(b"".join(raw[i:j]), "<u4"))
                if len(keys):
                    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    n = np.diff(np.concatenate([at, [len(keys)]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block[i])), pa.array(keys[at].astype(np.int64)), pa.array(n)], ["block", "pair", "k"])

    asks = store(rows.select("block", "pairs").mapInArrow(ask, "block long, pair long, k long"), "asks")
    counts = store(asks.groupBy("pair").agg(F.sum("k").alias("n")), "counts")
    a_id = F.shiftright("pair", 16).alias("a")
    top = counts.groupBy(a_id).agg(F.max("n").alias("top"))  # a row an A id: 65,536 at most
    marked = counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return asks, store(marked, "marked")


def align(
    docs: DataFrame, *, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN,
) -> DataFrame:
    """Groups of tokens of two tokenizers over the same bytes, and how often their ids are linked in the corpus.

    A text is encoded whole by both, special tokens' strings as ordinary text, and cut into groups where an A and
    a B token end at the same byte. Texts of ``chunk_bytes`` or more are cut into byte ranges; a range's fragment is an open prefix,
    closed groups and an open suffix, and Spark composes fragments as a tree, ``fan_in`` at a time. Every A token of a
    group is linked with every B token. A pair's count is the number of documents that hold it: blocks of documents
    hand in their distinct pairs once, and get back the counts of these.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id), count_sum
    (counts over links), groups_sha256, and the text's distinct pairs (A id << 16 | B id, uint32 bytes) with the links
    of each. Null and empty texts, and those whose tokens' bytes are not a space and the text, have zeros and an
    empty hash. Null ids are kept as null; repeated rows and rows of one id are documents each. A text is the unit of
    memory. An empty table gives no rows. Only the two named columns are read, so others may have any name.
    """
    first = store(aligned(docs, vocabulary_a, vocabulary_b, id_col, text_col, chunk_bytes, block_bytes), "aligned")
    own = [c.split()[0] for c in f"{HEAD}, {OWN}".split(", ")]
    rows = first.filter("chunk is null").select(*own)
    pieces = first.filter("chunk is not null")
    if not pieces.isEmpty():
        rows = rows.unionByName(store(composed(pieces, fan_in), "long"))
    asks, marked = pair_counts(rows)
    answers = join_checked(asks.select("block", "pair"), marked, "pair").select("block", "pair", "n", "best")

    names = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, pairs binary, times binary"
    schema = arrow_schema(names)

    def answer(texts: pa.Table, told: pa.Table) -> pa.Table:
        known = told.column("pair").to_numpy()
        order = np.argsort(known)
        known, n, best = known[order], told.column("n").to_numpy()[order], told.column("best").to_numpy()[order]
        raw = texts.column("pairs").to_pylist()
        keys, times = np.frombuffer(b"".join(raw), "<u4"), np.frombuffer(b"".join(texts.column("times").to_pylist()), "<u4").astype(np.int64)
        at = np.searchsorted(known, keys)
        bound = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)

        best, n = (best[at], n[at]) if len(keys) else (times, times)  # no pairs, no answers
        cols = {"n_best": pa.array(sums(times * best, bound)), "count_sum": pa.array(sums(times * n, bound))}
        return pa.Table.from_arrays([cols[f.name] if f.name in cols else texts.column(f.name) for f in schema], schema=schema)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, names)


def op13_align(spark, sf_dir):
    return align(table(spark, sf_dir, "documents")).drop("pairs", "times")
