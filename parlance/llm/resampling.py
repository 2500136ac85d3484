"""Target-distribution importance resampling over hashed n-grams, whose CRCs come from prefix CRCs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, join_checked, sliced, store, table

#: Bytes of an n-gram up to which one table look-up shifts a CRC past it; longer ones take one more for each bit of the rest.
DIRECT = 256
#: For bytes.translate: A-Z in lower case, ASCII letters and digits and all other bytes as they are, the rest as a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _byte_step() -> np.ndarray:
    """What a low byte of a CRC-32 becomes when one zero byte follows: 256 values by the definition of the code."""
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(0xEDB88320), v >> 1).astype(np.uint32)
    return v


@lru_cache(maxsize=1)
def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Multiplication by x**(8 n) over GF(2), modulo the CRC's polynomial, as look-ups of a CRC's four bytes.

    The first array has it for n under DIRECT, by n; the list for DIRECT times 1, 2, 4, ...
    """
    step = _byte_step()
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
    direct = np.empty((DIRECT, 4, 256), np.uint32)
    direct[0] = unit
    for n in range(1, DIRECT):
        direct[n] = (direct[n - 1] >> np.uint32(8)) ^ step[direct[n - 1] & np.uint32(0xFF)]
    last = (direct[-1] >> np.uint32(8)) ^ step[direct[-1] & np.uint32(0xFF)]
    powers = [last]
    for _ in range(23):  # up to 2**31 bytes
        powers.append(_apply(powers[-1], powers[-1]))
    return direct, powers


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(0xFF)
    return shift[0, crc & low] ^ shift[1, (crc >> np.uint32(8)) & low] ^ shift[2, (crc >> np.uint32(16)) & low] ^ shift[3, crc >> np.uint32(24)]


def crc_past(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 values shifted past ``length`` bytes each, so that crc(a + b) is crc_past(crc(a), len(b)) ^ crc(b)."""
    direct, powers = shift_tables()
    low, rest = np.uint32(0xFF), length // DIRECT
    n = length % DIRECT
    out = direct[n, 0, crc & low] ^ direct[n, 1, (crc >> np.uint32(8)) & low] ^ direct[n, 2, (crc >> np.uint32(16)) & low] ^ direct[n, 3, crc >> np.uint32(24)]
    for k, shift in enumerate(powers):
        if not rest.any():
            break
        at = np.flatnonzero(rest & 1)
        out[at] = _apply(shift, out[at])
        rest = rest >> 1
    return out


class Prefixes:
    """Running CRCs of normalised documents (words joined by one space), read once each.

    ``before[i]`` and ``after[i]`` are the CRCs of a document's bytes before and through its word i, ``first[i]``
    and ``last[i]`` the bytes' number there; ``own[d]`` and the value after it bound the words of document d.
    """

    def __init__(self, texts: list[str | None]):
        before, after, size, own = [], [], [], [0]
        crc32 = zlib.crc32
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()
            c = 0
            for w in words:
                before.append(c)
                c = crc32(w, c)
                after.append(c)
                c = crc32(b" ", c)
            size.extend(map(len, words))
            own.append(len(size))
        self.before, self.after = np.array(before, np.uint32), np.array(after, np.uint32)
        length = np.array(size, np.int64)
        self.last = np.cumsum(length + 1) - 1  # places over all documents: only differences inside one count
        self.first = self.last - length
        self.own = np.array(own, np.int64)

    def ngrams(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of every run of 1 to ``longest`` words of a document, grouped by document, and the groups' bounds."""
        n = np.diff(self.own)
        doc = np.repeat(np.arange(len(n)), n)
        crcs, docs = [], []
        for k in range(longest):
            i = np.arange(max(len(doc) - k, 0))
            i = i[doc[i] == doc[i + k]] if k else i
            crcs.append(self.after[i + k] ^ crc_past(self.before[i], self.last[i + k] - self.first[i]))
            docs.append(doc[i])
        order = np.argsort(np.concatenate(docs), kind="stable")
        counts = sum(np.maximum(n - k, 0) for k in range(longest))
        return np.concatenate(crcs)[order], np.concatenate([[0], np.cumsum(counts)])


def hashed_features(df: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """Per row: id, n_words, n_features, and the features' buckets as little-endian 16- or 32-bit integers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            p = Prefixes(b.column(1).to_pylist())
            crcs, bounds = p.ngrams(longest)
            which = (crcs % np.uint32(buckets)).astype(kind)
            packed = [which[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(p.own)), pa.array(np.diff(bounds)), pa.array(packed, pa.binary())], ["id", "n_words", "n_features", "buckets"]
            )

    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return cols.mapInArrow(run, "id long, n_words long, n_features long, buckets binary")


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """Features of all rows in each bucket that has any: bucket, n. A task sends one sum a bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in sliced(batches, 0):
            for raw in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw or b"", kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> np.ndarray:
    """Whole thousandths of the log ratio of add-one probabilities in target and source, by bucket.

    Both tables are of bucket and n, so what the driver reads is bounded by the number of buckets.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, frame in ((s, source), (t, target)):
        got = frame.toArrow()
        counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(scale * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(seed: int, doc_id: int | None, scale: int = 1000) -> int:
    """Whole thousandths of a Gumbel number from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 5, seed: int = 42, least_words: int = 20, longest: int = 3, buckets: int = 10_000,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Scores of all documents and the ranks of those drawn without replacement towards the target's n-grams.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Features are
    the runs of 1 to ``longest`` words, joined by one space; a feature's bucket is its CRC-32 modulo ``buckets``.
    Every document is read once, word by word, with a running CRC; a feature's CRC is the one after its last word
    less the one before its first, shifted past its bytes. A document's weight is the sum of its features' gains
    (:func:`gains`) and its score the weight and a Gumbel number, so the highest scores are a sample without
    replacement. Of the documents of ``least_words`` words or more, ``percent`` in a hundred are drawn.

    Returns doc_id, n_words, n_features, weight, score, rank (from 1, ties to the smaller doc_id; null if not
    drawn). Null and empty texts have no features and weight 0; a null id takes part with the hash of the word
    null, and comes first in ties; repeated rows are ranked each. A very long text is one array of buckets. Without
    documents there are no rows, without a target all gains follow from zero counts. Only the named columns are read.
    """
    features = store(hashed_features(docs, id_col, text_col, longest, buckets), "features")
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text_col}`").alias("text"))
    gain = gains(bucket_counts(features, buckets), bucket_counts(hashed_features(wanted, "id", "text", longest, buckets), buckets), buckets)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 3):
            weights = [int(gain[np.frombuffer(raw, kind)].sum()) for raw in b.column(3).to_pylist()]
            scores = [w + noise(seed, i) for w, i in zip(weights, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    scored = store(features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    # a global order in two passes: what each range holds, then the places in it
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    ranged = fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = store(ranged, "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    places = store(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first")).alias("ahead")), "places")  # one row a range
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = join_checked(ranged, places, "part").withColumn("rank", F.col("at") + F.col("ahead") + 1)
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose id is drawn; rows of one id go together, and none without an id."""
    ids = importance_resample(docs, target, id_col=id_col, **options).filter("rank is not null and doc_id is not null")
    name = fresh(docs.columns, "_drawn")
    drawn = store(ids.select(F.col("doc_id").alias(name)).distinct(), "drawn")
    return join_checked(docs, drawn, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_semi")


def op12_resample(spark, sf_dir):
    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
