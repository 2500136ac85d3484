"""Encoding whole texts with a public tokenizer, with each distinct piece encoded once per worker."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker's memo is emptied of its older half beyond this many pieces, so its memory is bounded.
MEMO = 150_000
#: White space other than single spaces and line feeds (RE2 syntax): such texts are encoded whole.
ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]| [ \n]|\n[ \n]|[ \n]\z"
#: A letter and an ASCII mark after it: both kinds of tokenizer cut there, if the letter is one in its normal form too.
MARK = r"(\p{L})([.,!?;:%$#&*|])"
#: A word of Latin-1 letters, with or without the space before it.
PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def split_numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts of texts cut at null characters: the distinct parts, the number of each part, and the texts' bounds in them."""
    parts = pc.split_pattern(texts, "\0")
    numbered = parts.flatten().dictionary_encode()
    return numbered.dictionary, numbered.indices.to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def gathered(ids: np.ndarray, size: np.ndarray, which: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts from those of their parts: part k has the next ``size[k]`` ids; and the bounds of the texts' ids."""
    start = np.cumsum(size) - size
    ends = np.concatenate([[0], np.cumsum(size[which])])
    return ids[np.repeat(start[which] - ends[:-1], size[which]) + np.arange(ends[-1])], ends[bound]


@lru_cache(maxsize=4)
def loose_letters(path: str) -> str:
    """Letters that a tokenizer's normalizer ends in something else: such a mark and what follows may be one pre-token."""
    normal = load(path).normalizer
    if normal is None:
        return ""
    letters = (chr(i) for i in range(0x80, 0x110000) if unicodedata.category(chr(i))[0] == "L")
    return "".join(x for x in letters if unicodedata.category((normal.normalize_str(x) or "?")[-1])[0] != "L")


@lru_cache(maxsize=8)
def load(path: str, plain_specials: bool = False):
    """The tokenizer of a file; with ``plain_specials``, strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain_specials
    return t


class Encoder:
    """Ids of whole texts as little-endian uint16 arrays, equal to the library's; at most 65,536 ids.

    Neither kind of tokenizer joins characters across the start of a run of white space, so a text whose white
    space is single spaces and line feeds is the concatenation of its pieces: a word with the space before it
    (``keep_space``, byte-level BPE), or the bare word (BPE with word ends, which drops white space). Texts are
    split and their pieces numbered by Arrow, each new piece goes through the library once, and the ids of all
    texts are gathered at once. Texts with other white space, or with the string of a special token, go to the
    library whole, as do texts with a letter whose normal form ends in a combining mark.
    """

    def __init__(self, path: str, keep_space: bool, plain_specials: bool = False):
        self.keep_space = keep_space
        self.tok = load(path, plain_specials)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        specials = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        loose = "".join(f"\\x{{{ord(x):x}}}" for x in loose_letters(path))
        self.odd = "|".join([ODD, *(f"(?i:{s})" for s in specials), *([f"[{loose}]"] if loose else [])])
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.lower = self.tok.normalizer is not None  # that of the vocabulary with word ends lower-cases
        self.line = np.array(self.tok.encode("\n", add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces. A plain word is one pre-token and goes to the library's model; any other piece to the library."""
        young, lower, model, whole = self.young, self.lower, self.tok.model.tokenize, self.tok.encode
        for x in pieces:
            if PLAIN(x):
                x_ = x.lower() if lower else x
                x_ = x_.replace(" ", "\u0120") if x_.isascii() else x_.encode().decode("latin-1").translate(BYTE_CHARS)
                ids = [t.id for t in model(x_)]
            else:
                ids = whole(x, add_special_tokens=False).ids
            young[x] = array("H", ids).tobytes()

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        if len(young) > MEMO:
            self.young, self.old = young, old = {"": b""}, young
        if self.keep_space:
            young["\n"] = self.line
        found = list(map(young.get, pieces))
        if None in found:
            lacking = [x for x, f in zip(pieces, found) if f is None]
            young.update((x, old[x]) for x in lacking if x in old)
            if new := [x for x in lacking if x not in young]:
                self._learn(new)
            found = list(map(young.get, pieces))
        return found

    def encode_many(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = pc.if_else(odd, "", texts)
        if self.keep_space:  # "a b\nc" -> "a", " b", "\n", "c"
            cut = pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0")
        else:
            cut = pc.replace_substring(pc.replace_substring(cut, "\n", "\0"), " ", "\0")
        pieces, which, bound = split_numbered(cut)
        marked, own, edge = split_numbered(pc.replace_substring_regex(pieces, MARK, "\\1\0\\2"))  # far fewer distinct words
        known = self._ids_of(marked.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        ids, cuts = gathered(np.frombuffer(b"".join(known), "<u2"), size, own, edge)
        every, bound = gathered(ids, np.diff(cuts), which, bound)
        out = [every[i:j] for i, j in zip(bound[:-1].tolist(), bound[1:].tolist())]
        for i in whole.tolist():
            out[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u2")
        return out


@lru_cache(maxsize=4)
def encoder(path: str, keep_space: bool, plain_specials: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the Python worker does."""
    return Encoder(path, keep_space, plain_specials)


def public_path(name: str) -> str:
    """Place of a public vocabulary file, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
