"""Toxicity scoring: a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, id_remainder, join_checked, map_texts, sliced, store, table, words_of

#: The fit reads at most this many labelled documents of each class, those of the smallest id hash, and no
#: document of more characters than this.
FIT_DOCS, FIT_CHARS = 2500, 200_000  # see score_toxicity
#: A window of words, and its step: consecutive windows overlap by a quarter and cover the whole text.
WINDOW, STEP = 32, 24
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN = 4, 4, 8


def clean(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]{}*#$%&|<>-_") or word


GRAMS = (3, 4, 5, 6)


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' character 3- to 6-grams, their ends marked.

    Returns buckets (grams, characters), with ``CHAR_BUCKETS`` where a gram would pass the end of its word, the
    first character of each word and the word of each character. A gram's hash depends on its bytes alone.
    """
    marked = [b"^" + w + b"$" for w in words]
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    size = np.array([len(w) for w in marked])
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = first[word] + size[word] - np.arange(len(text))  # characters to the end of the word
    out = np.full((len(GRAMS), len(text)), CHAR_BUCKETS, np.int64)
    code = np.zeros(len(text), np.uint32)
    padded = np.concatenate([text, np.zeros(max(GRAMS), np.uint32)])
    for n in range(1, max(GRAMS) + 1):
        code = code * np.uint32(0x01000193) + padded[n - 1 : n - 1 + len(text)] + np.uint32(1)
        if n in GRAMS:
            h = code ^ (code >> np.uint32(15))
            h = h * np.uint32(0x85EBCA6B)
            bucket = (h >> np.uint32(18)).astype(np.int64)
            out[GRAMS.index(n)] = np.where(left >= n, bucket % CHAR_BUCKETS, CHAR_BUCKETS)
    return out, first, word


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORD_BUCKETS


class WordInputs:
    """Inputs of distinct words: the embedding of the word's bucket beside the largest embeddings of its characters."""

    def __init__(self, model: dict, memo: int = 300_000):
        self.model, self.memo, self.rows = model, memo, {}
        self.chars = np.concatenate([model["char"], np.full((1, CHAR_DIM), -1e9, np.float32)])
        self.table = np.zeros((1024, WORD_DIM + CHAR_DIM), np.float32)

    def index(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in ``table``; new words are added."""
        if len(self.rows) > self.memo:
            self.rows.clear()
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            first = len(rows)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            plain = [clean(w) for w in new]
            grams, start, _ = gram_buckets(plain)
            part = self.table[first : first + len(new)]
            part[:, :WORD_DIM] = self.model["word"][[word_bucket(w) for w in plain]]
            pooled = [np.maximum.reduceat(self.chars[g], start) for g in grams]
            part[:, WORD_DIM:] = np.maximum.reduce(pooled)
            rows.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def tanh(x: np.ndarray) -> np.ndarray:
    """Through exp, which numpy vectorises."""
    with np.errstate(over="ignore"):
        return 1 - 2 / (1 + np.exp(2 * x))


def gru(x: np.ndarray, mask: np.ndarray, p: dict, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of a gated recurrent unit over x (T, B, D); masked steps carry the state over."""
    T, B, _ = x.shape
    H = HIDDEN
    gates = x.reshape(T * B, -1) @ p["W"] + p["b"]
    gates = gates.reshape(T, B, 3 * H)
    h = np.zeros((B, H), np.float32)
    out = np.empty((T, B, H), np.float32)
    for t in range(T):
        u = h @ p["U"]
        zr = sigmoid(gates[t, :, : 2 * H] + u[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        c = tanh(gates[t, :, 2 * H :] + r * u[:, 2 * H :])
        step = (1 - z) * mask[t]
        if keep is not None:
            keep.append((h, z, r, c, u[:, 2 * H :]))
        h = h + step * (c - h)
        out[t] = h
    return out


def gru_back(grad: np.ndarray, x: np.ndarray, mask: np.ndarray, p: dict, kept: list) -> tuple[np.ndarray, dict]:
    """Gradients of inputs and parameters for :func:`gru`."""
    T, B, D = x.shape
    H = HIDDEN
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dx = np.empty_like(x)
    dh = np.zeros((B, H), np.float32)
    for t in range(T - 1, -1, -1):
        h, z, r, c, uc = kept[t]
        dh = dh + grad[t]
        m = mask[t]
        dc = dh * (1 - z) * m * (1 - c * c)
        dz = -dh * (c - h) * m * z * (1 - z)
        dr = dc * uc * r * (1 - r)
        du = np.concatenate([dz, dr, dc * r], axis=1)
        dg = np.concatenate([dz, dr, dc], axis=1)
        g["W"] += x[t].T @ dg
        g["b"] += dg.sum(axis=0)
        g["U"] += h.T @ du
        dx[t] = dg @ p["W"].T
        dh = dh * (1 - (1 - z) * m) + du @ p["U"].T
    return dx, g


def forward(model: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Log-odds of windows x (T, B, D)."""
    kf, kb = ([], []) if keep is not None else (None, None)
    f = gru(x, mask, model["fwd"], kf)
    b = gru(x[::-1], mask[::-1], model["bwd"], kb)[::-1]
    s = np.concatenate([f, b], axis=2)
    e = tanh(s) @ model["att"]
    e = np.where(mask[:, :, 0] > 0, e, -1e9)
    a = np.exp(e - e.max(axis=0))
    a *= mask[:, :, 0]
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = (a[:, :, None] * s).sum(axis=0)
    if keep is not None:
        keep.update(kf=kf, kb=kb, s=s, a=a, pooled=pooled)
    return pooled @ model["out"] + model["bias"][0]


def windows_of(rows: np.ndarray) -> np.ndarray:
    """Start of every window of a text with that many words."""
    n = len(rows)
    return np.arange(0, max(1, n - WINDOW + STEP), STEP) if n else np.zeros(0, np.int64)


def laid_out(rows: list[np.ndarray], table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as x (T, B, D) and mask (T, B, 1)."""
    at = np.zeros((WINDOW, len(rows)), np.int64)
    mask = np.zeros((WINDOW, len(rows), 1), np.float32)
    for i, r in enumerate(rows):
        at[: len(r), i] = r
        mask[: len(r), i] = 1
    return table_[at] * mask, mask


def log_odds(held: Iterator[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Log-odds of label 1 for texts that hold a bucket, shrunk toward zero by 2.5 standard errors."""
    c = np.zeros((2, size))
    for buckets, lab in zip(held, y):  # one text at a time: the sets of all texts together are large
        c[int(lab), np.unique(buckets)] += 1
    n1, n0 = max(1.0, float(y.sum())), max(1.0, float((1 - y).sum()))
    lo = np.log((c[1] + 0.3) / (n1 + 0.6)) - np.log((c[0] + 0.3) / (n0 + 0.6))
    error = np.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5))
    return (np.sign(lo) * np.clip(np.abs(lo) - 2.5 * error, 0, 4)).astype(np.float32)


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 12, seed: int = 7, batch: int = 128) -> dict:
    """Train the network on whole texts, each represented by its most suspect window.

    The first dimension of either embedding starts at the log-odds with which the training texts that hold the
    word (or the characters) are toxic; all parameters are then trained by Adam. A toxic text need not be toxic
    throughout, so a text is trained on its window of the highest score (chosen anew before some epochs), and
    every other text also on a window drawn at random.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    at: dict[bytes, int] = {}
    rows = [np.array([at.setdefault(clean(w), len(at)) for w in words_of(t, lower=True)], np.int32) for t in texts]
    names = list(at)
    del at
    wb = np.array([word_bucket(w) for w in names], np.int64)
    pieces, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(names), 20_000):  # buckets of every word's characters, word by word
        grams, first, word_of = gram_buckets(names[k : k + 20_000])
        of = np.broadcast_to(word_of, grams.shape)[grams < CHAR_BUCKETS]
        pieces.append(grams[grams < CHAR_BUCKETS].astype(np.int32)[np.argsort(of, kind="stable")])
        sizes.append(np.bincount(of, minlength=len(first)))
    flat, size = np.concatenate(pieces), np.concatenate(sizes)
    del names, pieces
    cut = np.concatenate([[0], np.cumsum(size)])

    def chars_of(words: np.ndarray) -> np.ndarray:
        """Buckets of some words' characters, word after word."""
        n = size[words]
        return flat[np.repeat(cut[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    model = {
        "word": rng.normal(0, 0.02, (WORD_BUCKETS, WORD_DIM)).astype(np.float32),
        "char": rng.normal(0, 0.02, (CHAR_BUCKETS, CHAR_DIM)).astype(np.float32),
        "att": np.full(2 * HIDDEN, 0.5, np.float32),
        "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "bias": np.array([-1.0], np.float32),
    }
    for side in ("fwd", "bwd"):
        model[side] = {
            "W": rng.normal(0, 0.3, (WORD_DIM + CHAR_DIM, 3 * HIDDEN)).astype(np.float32),
            "U": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
            "b": np.zeros(3 * HIDDEN, np.float32),
        }
    live = [i for i, r in enumerate(rows) if len(r)]
    n1, n0 = float(y.sum()), float((1 - y).sum())
    if not live or not n1 or not n0:  # one class only: the prior
        model["out"][:], model["bias"][0] = 0, np.log((n1 + 1) / (n0 + 1))
        return model
    model["word"][:, 0] = log_odds((wb[r] for r in rows), y, WORD_BUCKETS)
    model["char"][:, 0] = log_odds((chars_of(np.unique(r)) for r in rows), y, CHAR_BUCKETS)

    starts = [windows_of(r) for r in rows]
    owner = np.repeat(live, [len(starts[i]) for i in live])
    every = np.stack([owner, np.concatenate([starts[i] for i in live])], axis=1)
    weight = np.where(y > 0, min(3.0, max(1.0, (n0 / n1) ** 0.5)), 1.0).astype(np.float32)
    moments: dict = {}
    best: dict[int, int] = {}

    def inputs() -> np.ndarray:
        out = np.empty((len(wb), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = model["word"][wb]
        for k in range(0, len(wb), 20_000):  # the embeddings of all words' characters together are large
            edge = cut[k : k + 20_001]
            out[k : k + 20_000, WORD_DIM:] = np.maximum.reduceat(model["char"][flat[edge[0] : edge[-1]]], edge[:-1] - edge[0])
        return out

    def adam(value: np.ndarray, g: np.ndarray, key: tuple, rate: float, step: int, only: np.ndarray | None = None) -> None:
        m1, m2 = moments.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        k = slice(None) if only is None else only
        m1[k] = 0.9 * m1[k] + 0.1 * g
        m2[k] = 0.995 * m2[k] + 0.005 * g * g
        value[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-6)

    step = 0
    for epoch in range(epochs):
        if epoch in (0, 1, 2, 4, 7):
            table_ = inputs()
            if epoch:
                got = np.concatenate([forward(model, *laid_out([rows[i][s : s + WINDOW] for i, s in every[k : k + 2048]], table_)) for k in range(0, len(every), 2048)])
            else:
                lead = np.maximum(table_[:, 0], table_[:, WORD_DIM])
                got = np.array([np.sort(lead[rows[i][s : s + WINDOW]])[-3:].sum() for i, s in every])
            order = np.lexsort((got, owner))
            last = np.flatnonzero(np.concatenate([owner[order][1:] != owner[order][:-1], [True]]))
            best = {int(i): int(s) for i, s in every[order[last]]}
        jobs = [(i, best[i]) for i in live] + [(i, int(rng.choice(starts[i]))) for i in live if not y[i]]
        jobs = [jobs[j] for j in rng.permutation(len(jobs))]
        for k in range(0, len(jobs), batch):
            part, step = jobs[k : k + batch], step + 1
            ids = np.zeros((WINDOW, len(part)), np.int64)
            mask = np.zeros((WINDOW, len(part), 1), np.float32)
            for j, (i, s) in enumerate(part):
                w = rows[i][s : s + WINDOW]
                ids[: len(w), j], mask[: len(w), j] = w, 1
            used, back = np.unique(ids, return_inverse=True)
            own = chars_of(used)
            length = size[used]
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            drawn = model["char"][own]
            pooled_chars = np.maximum.reduceat(drawn, first)
            table_ = np.concatenate([model["word"][wb[used]], pooled_chars], axis=1)
            x = table_[back.reshape(ids.shape)] * mask
            kept: dict = {}
            logit = forward(model, x, mask, kept)
            who = [i for i, _ in part]
            d = ((sigmoid(logit) - y[who]) * weight[who] / len(part)).astype(np.float32)
            s_, a, pooled = kept["s"], kept["a"], kept["pooled"]
            dp = d[:, None] * model["out"]
            da = (s_ * dp).sum(axis=2)
            de = a * (da - (a * da).sum(axis=0))
            th = tanh(s_)
            ds = a[:, :, None] * dp + de[:, :, None] * model["att"] * (1 - th * th)
            dxf, gf = gru_back(ds[:, :, :HIDDEN], x, mask, model["fwd"], kept["kf"])
            dxb, gb = gru_back(ds[::-1, :, HIDDEN:], x[::-1], mask[::-1], model["bwd"], kept["kb"])
            dx = ((dxf + dxb[::-1]) * mask).reshape(-1, WORD_DIM + CHAR_DIM)
            by_used = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32)
            np.add.at(by_used, back.ravel(), dx)
            adam(model["out"], pooled.T @ d, ("out",), 0.01, step)
            adam(model["bias"], np.array([d.sum()], np.float32), ("bias",), 0.01, step)
            adam(model["att"], (th * de[:, :, None]).sum(axis=(0, 1)), ("att",), 0.01, step)
            for side, g in (("fwd", gf), ("bwd", gb)):
                for q, v in g.items():
                    adam(model[side][q], v, (side, q), 0.01, step)
            for key, buckets, grad in (
                ("word", wb[used], by_used[:, :WORD_DIM]),
                ("char", own, np.repeat(by_used[:, WORD_DIM:], length, axis=0) * (drawn == np.repeat(pooled_chars, length, axis=0))),
            ):
                only, place = np.unique(buckets, return_inverse=True)
                g = np.zeros((len(only), grad.shape[1]), np.float32)
                np.add.at(g, place, grad)
                adam(model[key], g, (key,), 0.002, step, only)
    return model


def text_scores(texts: list[str | None], model: dict, inputs: WordInputs, batch: int = 2048) -> np.ndarray:
    """Score of each whole text: the highest of all its windows; an empty text has the score of an empty window."""
    best = np.full(len(texts), -np.inf, np.float32)
    rows: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if rows:
            x, mask = laid_out(rows, inputs.table)
            np.maximum.at(best, owner, forward(model, x, mask))
            rows.clear()
            owner.clear()

    for i, t in enumerate(texts):
        words = words_of(t, lower=True)
        for part in range(0, len(words), STEP * 4096):  # very long texts go through in overlapping stretches
            own = inputs.index(words[part : part + STEP * 4096 + WINDOW - STEP])
            for s in windows_of(own):
                rows.append(own[s : s + WINDOW])
                owner.append(i)
                if len(rows) >= batch:
                    flush()
            if len(inputs.rows) > inputs.memo:
                flush()
    flush()
    best[np.isneginf(best)] = model["bias"][0]
    return 1 / (1 + np.exp(-best.astype(np.float64)))


def training_rows(docs: DataFrame, labels: DataFrame, fit_docs: int, fit_chars: int, folds: int, held_fold: int) -> DataFrame:
    """The bounded training sample: at most ``fit_docs`` labelled documents a class outside the held-out fold, a row an id.

    Documents of more than ``fit_chars`` characters are left out before the draw, so they cost the sample no place.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter((id_remainder(F.col("label_id"), folds) != held_fold) & F.col("toxic").isNotNull()).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= fit_chars)
    known = known.join(short.select(F.col("doc_id").alias("label_id")).distinct().hint("merge"), "label_id", "left_semi")
    order = F.xxhash64(F.lit(17), F.col("label_id"))
    picked = [known.filter(F.col("toxic") == c).orderBy(order, "label_id").limit(fit_docs) for c in (0, 1)]
    sample = store(picked[0].unionByName(picked[1]), "sample")
    rows = join_checked(short, sample, F.col("doc_id") == F.col("label_id"), rows=2 * fit_docs)
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame, fit_docs: int, fit_chars: int, id_col: str, text_col: str) -> dict:
    """The model, fitted in one task of an executor to the bounded sample; its size is fixed, so it may come to the driver."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = store(training_rows(cols, labels, fit_docs, fit_chars, 5, 0), "training")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        model = pickle.dumps(fit(texts, np.array(toxic)))
        del texts
        give_back()
        yield pa.RecordBatch.from_pydict({"model": [model]})

    one = sample.coalesce(1).sortWithinPartitions("doc_id").select("text", "toxic")
    return pickle.loads(store(one.mapInArrow(run, "model binary"), "model").first()["model"])


def score_toxicity(docs: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole document: doc_id, held_out, score, predicted.

    The network is fitted in one task to a bounded sample: at most ``fit_docs`` labelled documents of each class,
    of at most ``fit_chars`` characters, whose crc32(doc_id as text) mod 5 is not 0. Every document is then
    scored in one narrow pass over all its overlapping windows, however long it is.

    Null and empty texts get the score of an empty window; labels without a document or without a value are
    ignored, and a document's labels combine to the highest; a null doc_id is scored, never held out and never
    trained on. Repeated rows each get a row, and rows of one id train once, by the smallest text. With no
    labels, or labels of one class, all scores are the prior; an empty table gives an empty result. Only the
    named columns are read, so other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fit_docs, fit_chars, id_col, text_col))  # of fixed size

    def scorer():
        inputs = WordInputs(shared.value)
        return lambda texts: [text_scores(texts, shared.value, inputs)]

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_texts(cols, scorer, "doc_id long, score double", 1)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose score is under ``threshold``; the score is that of :func:`score_toxicity`.

    Nulls, long and empty texts, repeated rows, labels and empty tables are treated as there; columns of any name
    pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fit_docs, fit_chars, id_col, text_col))  # of fixed size
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = WordInputs(shared.value)
        for b in sliced(batches, at):
            yield b.filter(pa.array(text_scores(b.column(at).to_pylist(), shared.value, inputs) < threshold))
        del inputs
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
