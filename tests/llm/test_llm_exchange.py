"""Sharding, importance resampling and tokenizer alignment against brute force: nulls, ties, repeats, long texts, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("parlance.llm")
from parlance.llm import alignment, resampling, shards  # noqa: E402
from parlance.llm.tokens import BYTE_CHARS, public_path  # noqa: E402

DOCS = "doc_id long, text string, shard int, slot string, n_words int, pair string, chunk int"
PROSE = " ".join(f"Word{i % 97}x{i % 13}" for i in range(400))
TEXTS = [
    PROSE, PROSE, PROSE + " end", None, "", "   ", "a", "a b c", "Öl und Bö\nzwei  Leer", "x" * 5000, "the quick brown fox jumps over the lazy dog " * 60, " lead", "tail ", "\nab cd",
    "a▁b", "tab\there", "x\0y", "<s>x</s> <|endoftext|>", "中文，字 😀", "\n", " ", "é́ combining.̸ a*́", "中" * 3000, "ab\ncd. ef,\ngh don't " * 900, "y" * 70_000,
]


def frame(spark, texts):
    rows = [(None if i % 11 == 5 else i, t, 3, "s", 7, "p", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:3]], DOCS).repartition(3)


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


# --- 11 shards

def test_hypergeometric_follows_its_distribution(spark):
    n, good, draws = 30, 12, 10
    x = shards.hypergeometric(shards.uniform(F.lit(5), F.col("id")), *(F.lit(float(v)) for v in (n, good, draws)))
    got = {int(r["x"]): r["k"] / 100_000 for r in spark.range(100_000).groupBy(x.alias("x")).agg(F.count("*").alias("k")).collect()}
    for k in range(draws + 1):
        assert abs(got.get(k, 0) - math.comb(good, k) * math.comb(n - good, draws - k) / math.comb(n, draws)) < 0.006


def test_hypergeometric_stays_in_its_support(spark):
    cases = [(0, 0, 0), (5, 5, 3), (5, 0, 3), (7, 4, 7), (10**12, 10**11, 10**5), (10**6, 1, 10**6 - 1)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "n double, g double, d double")
    got = df.select("*", shards.hypergeometric(F.lit(0.999999), F.col("n"), F.col("g"), F.col("d")).alias("x")).collect()
    assert all(max(0, r.d + r.g - r.n) <= r.x <= min(r.d, r.g) for r in got)
    far = next(r for r in got if r.n == 10**12)
    assert 300 < 10**4 - far.x < 600  # the walk goes up from the mode, then down: nearly five deviations of 95 below


@pytest.mark.parametrize("fan_out", [2, 7, 256])
def test_matrix_has_exact_margins(spark, fan_out):
    sizes = {i: (i * 7919) % 50 for i in range(90) if i % 4}  # gaps in the numbers of parts
    m = shards.communication_matrix(spark.createDataFrame(list(sizes.items()), "part long, n long"), 8, 1, fan_out)
    got = {r["part"]: r["counts"] for r in m.collect()}
    assert {k: sum(v) for k, v in got.items()} == sizes
    cols = np.array(list(got.values())).sum(0)
    assert cols.max() - cols.min() <= 1 and min(min(v) for v in got.values()) >= 0


def test_chain_spreads_like_a_uniform_shuffle(spark):
    """Of 60 rows, what the parts of 20, 25 and 15 send to a shard of 15 is hypergeometric, the first and the last part alike."""
    children = F.array(*[F.struct(F.lit(k).cast("long").alias("node"), F.lit(n).cast("long").alias("n")) for k, n in enumerate((20, 25, 15))])
    drawn = spark.range(3000).select(shards.chain(children, F.array(*[F.lit(15.0)] * 4), F.lit(9), F.col("id")).alias("c")).collect()
    for part, n in ((0, 20), (2, 15)):
        x = np.array([r["c"][part]["counts"] for r in drawn])
        assert (x.sum(1) == n).all() and np.abs(x.mean(0) - n / 4).max() < 0.15
        assert np.abs(x.var(0) - 15 * (n / 60) * (1 - n / 60) * 45 / 59).max() < 0.2
    assert (np.array([[c["counts"] for c in r["c"]] for r in drawn]).sum(1) == 15).all()


def test_shards_keep_every_row_and_have_exact_sizes(spark):
    docs = frame(spark, TEXTS)
    out = shards.shuffle_to_shards(docs, 8, text_col="text")
    assert out.columns == [*docs.columns, "shard_", "slot_"]  # docs has columns of these names
    assert rows(out, *docs.columns) == rows(docs, *docs.columns)
    slots = collections.defaultdict(list)
    for r in out.collect():
        slots[r["shard_"]].append(r["slot_"])
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_plan_is_native_and_small_tables(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(3)], "doc_id long, text string")
    out = shards.shuffle_to_shards(docs, 8)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert sorted(r["shard"] for r in out.collect()) == [0, 1, 2] and {r["slot"] for r in out.collect()} == {0}
    assert shards.shuffle_to_shards(docs.limit(0), 8).count() == 0


def test_shuffle_is_uniform_over_places(spark):
    """Ranks of the first quarter of 400 rows: their mean over seeds is that of all, so no partition keeps to its place."""
    docs = spark.range(400, numPartitions=5).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    means, lead = [], collections.Counter()
    for seed in range(5):
        got = shards.shuffle_to_shards(docs, 4, seed=seed).collect()
        means.append(np.mean([r["shard"] * 100 + r["slot"] for r in got if r["doc_id"] < 100]))
        lead.update(r["doc_id"] // 100 for r in got if r["slot"] < 25)
    assert abs(np.mean(means) - 199.5) < 20 and max(lead.values()) - min(lead.values()) < 70


def test_written_shards_are_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    back = shards.write_shards(docs, str(tmp_path / "s"), 4)
    assert rows(back, "doc_id", "text") == rows(docs, "doc_id", "text")
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [12, 12, 13, 13]


# --- 12 resampling

def brute_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, percent, least_words):
    found = [(d, *brute_features(t)) for d, t in docs]
    s, t = collections.Counter(k for _, _, f in found for k in f), collections.Counter(k for x in target for k in brute_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10_000) / ((s[k] + 1) * (big_t + 10_000)))) for k in range(10_000)]
    out = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in f)
        out.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


TARGET = ["the quick brown fox", "Word3x3 word4x4", None, "", "zwei leer über"]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling_equals_brute_force(spark, percent):
    docs = frame(spark, TEXTS)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.importance_resample(docs, target, percent=percent)
    assert rows(got, "doc_id", "n_words", "n_features", "weight", "score", "rank") == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], TARGET, percent, 20)


def test_crc_of_long_and_short_runs():
    rng = np.random.default_rng(4)
    for a, b in itertools.product([0, 1, 5, 300], [0, 1, 2, 255, 256, 257, 511, 512, 70_000]):
        x, y = rng.bytes(a), rng.bytes(b)
        got = resampling.crc_past(np.array([zlib.crc32(x)], np.uint32), np.array([b]))[0] ^ np.uint32(zlib.crc32(y))
        assert int(got) == zlib.crc32(x + y)


def test_running_crcs_give_every_ngram():
    texts = [PROSE, None, "", "one", "one Two", "a" * 3000 + " b " + "c" * 700, "ÄÖ 1x, 2y!" * 50]
    crcs, bounds = resampling.Prefixes(texts).ngrams(3)
    for text, i, j in zip(texts, bounds, bounds[1:]):
        assert sorted((crcs[i:j] % 10_000).tolist()) == sorted(brute_features(text)[1])


def test_drawn_documents_and_empty_tables(spark):
    docs = frame(spark, TEXTS)
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    drawn = resampling.drawn_documents(docs, target, percent=50)
    ids = {r[0] for r in resampling.importance_resample(docs, target, percent=50).filter("rank is not null").select("doc_id").collect()} - {None}
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == ids
    assert resampling.importance_resample(docs.limit(0), target).count() == 0
    assert resampling.importance_resample(docs, target.limit(0)).count() == docs.count()


# --- 13 alignment

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    back = {chr(c): b for b, c in BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in BYTE_CHARS}
    spelled_a = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in tok.get_vocab().items()}
    spelled_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(model.id_to_piece, range(32_000))]
    return tok, model, spelled_a, spelled_b


def brute_groups(text, libraries):
    tok, model, spelled_a, spelled_b = libraries
    want = (" " + text).encode() if text else b""
    a, b = (tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text, num_threads=1)) if text else ([], [])
    if b"".join(spelled_a[i] for i in a) != want or b"".join(spelled_b[i] for i in b) != want:
        return []
    ends_a, ends_b = (list(itertools.accumulate(len(v[i]) for i in x)) for x, v in ((a, spelled_a), (b, spelled_b)))
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def brute_align(docs, libraries):
    found = [(d, brute_groups(t, libraries)) for d, t in docs]
    count = collections.Counter(x for _, g in found for x in {(p, q) for a, b in g for p in a for q in b})
    top = collections.defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = []
    for d, g in found:
        links = [(p, q) for a, b in g for p in a for q in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 600, "block_bytes": 4000, "fan_in": 3}])
def test_alignment_equals_brute_force(spark, libraries, sizes):
    """In the second case nearly all texts are reduced as trees of fragments."""
    docs = frame(spark, TEXTS)
    got = alignment.align(docs, **sizes)
    want = brute_align([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)
    assert rows(got, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == want
    assert sum(w[1] > 0 for w in want) > 15 and any(w[1] == 0 for w in want)


def test_alignment_of_no_documents(spark):
    assert alignment.align(frame(spark, []).limit(0)).count() == 0
    assert [r["n_a"] for r in alignment.align(frame(spark, [None, "", "a▁b"])).collect()] == [0] * 6


def test_fragments_form_a_monoid():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(4, 80))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, n))), n)) for _ in range(2)]
        ids = [rng.integers(0, 500, len(e)) for e in ends]
        whole = alignment.fragment(ids[0], ends[0], ids[1], ends[1])
        cuts = sorted({0, n, *rng.integers(0, n, 5).tolist()})
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            (a, ea), (b, eb) = ((i[(e > lo) & (e <= hi)], e[(e > lo) & (e <= hi)]) for i, e in zip(ids, ends))
            parts.append(alignment.fragment(a, ea, b, eb))
        left = right = alignment.EMPTY
        for x in parts:
            left = alignment.compose(left, x)
        for x in reversed(parts):
            right = alignment.compose(x, right)
        assert left == right == whole
        assert alignment.compose(whole, alignment.EMPTY) == whole == alignment.compose(alignment.EMPTY, whole)


def test_wide_groups_count_repeats_first(monkeypatch):
    rng = np.random.default_rng(8)
    n_a, n_b = rng.integers(1, 30, 50), rng.integers(1, 30, 50)
    a, b, text = rng.integers(0, 9, n_a.sum()), rng.integers(0, 9, n_b.sum()), np.sort(rng.integers(0, 4, 50))
    slim = alignment.id_pairs(a, b, n_a, n_b, text)
    monkeypatch.setattr(alignment, "WIDE", 10)
    wide = alignment.id_pairs(a, b, n_a, n_b, text)
    assert all(np.array_equal(x, y) for x, y in zip(slim, wide)) and slim[1].sum() == (n_a * n_b).sum()


# --- ids of letters that a normalizer takes apart

@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_letters_that_end_in_a_combining_mark_before_every_mark(name, keep):
    """Every letter whose composed and lower-cased form ends in something else than a letter, before each mark at which words are cut."""
    import unicodedata

    from tokenizers import Tokenizer

    from parlance.llm import tokens

    letters = [x for i in range(0x80, 0x20000) if unicodedata.category(x := chr(i))[0] == "L" and unicodedata.category(unicodedata.normalize("NFC", x).lower()[-1])[0] != "L"]
    assert len(letters) >= 60
    texts = [f"ab {x}{m} cd{m}{x}" for x in letters for m in ".,!?;:%$#&*|"]
    path = public_path(name)
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path, keep)
    assert [g.tolist() for g in enc.encode_many(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
