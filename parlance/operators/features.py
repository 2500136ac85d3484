"""Feature tables: one row a frame or utterance with a vector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

c = F.col


def apply_cmvn(feats: DataFrame, stats: DataFrame, norm_vars: bool = False, by: str = "spk") -> DataFrame:
    """Vectors less the mean of their speaker, over its deviation with ``norm_vars``; ``stats`` is one row a dimension."""
    mean = c("s") / c("n")
    sd = F.sqrt(F.greatest(c("s2") / c("n") - mean * mean, F.lit(1e-20)))
    m = stats.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dim", mean.alias("m"), sd.alias("d")))).alias("st"))
    z = F.zip_with("vec", "st", lambda x, t: (x - t["m"]) / t["d"] if norm_vars else x - t["m"])
    return feats.join(m, by).withColumn("vec", z).drop("st")


def select_dims(feats: DataFrame, ranges: str) -> DataFrame:
    """Dimensions by a list of ranges, such as ``0-12,39``."""
    dims = [d for r in ranges.split(",") for d in range(int(r.split("-")[0]), int(r.split("-")[-1]) + 1)]
    return feats.withColumn("vec", F.array(*[c("vec")[d] for d in dims]))


def splice(frames: DataFrame, left: int, right: int, step: int = 1) -> DataFrame:
    """Each frame's vector with those at offsets -left*step to right*step beside it; the end frames repeat past the ends."""
    w = Window.partitionBy("utt").orderBy("frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("vec").over(whole), F.last("vec").over(whole)

    def at(k: int) -> Column:
        return F.coalesce(F.lag("vec", -k).over(w), first) if k < 0 else F.coalesce(F.lead("vec", k).over(w), last) if k else c("vec")

    return frames.withColumn("vec", F.concat(*[at(k * step) for k in range(-left, right + 1)]))


def temporal_dct(frames: DataFrame, context: int, n_coef: int) -> DataFrame:
    """Cosine transform in time of the spliced window of one-dimensional frames."""
    t = 2 * context + 1
    basis = [[math.sqrt(2 / t) * math.cos(math.pi / t * k * (n + 0.5)) for n in range(t)] for k in range(n_coef)]
    s = splice(frames, context, context)
    dot = lambda b: F.aggregate(F.zip_with("vec", F.array(*[F.lit(x) for x in b]), lambda x, y: x * y), F.lit(0.0), lambda p, q: p + q)
    return s.withColumn("vec", F.array(*[dot(b) for b in basis]))


def hamming(frames: DataFrame, context: int) -> DataFrame:
    """Spliced one-dimensional frames under a Hamming window in time."""
    t = 2 * context + 1
    w = F.array(*[F.lit(0.54 - 0.46 * math.cos(2 * math.pi * i / (t - 1))) for i in range(t)])
    return splice(frames, context, context).withColumn("vec", F.zip_with("vec", w, lambda x, y: x * y))


def coverage(feats: DataFrame, utt2spk: DataFrame) -> DataFrame:
    """Utterances, those with features, and whether under 95 % have them."""
    have = feats.select("utt").distinct().withColumn("_f", F.lit(True))
    t = utt2spk.join(have, "utt", "left").agg(F.count("*").alias("n_utts"), F.count("_f").alias("n_feats"))
    return t.withColumn("serious", c("n_feats") < 0.95 * c("n_utts"))


def spread_to_utterances(vectors: DataFrame, utt2spk: DataFrame) -> DataFrame:
    """Speaker values copied to each of the speaker's utterances."""
    return utt2spk.join(vectors, "spk").drop("spk")
