"""Counts, error rates, probabilities and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n"))


def top_words(words: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most frequent words with their share of all tokens; ties in byte order."""
    total = words.agg(F.count("*").alias("total"))
    top = word_counts(words).orderBy(F.desc("n"), "word").limit(n)
    return top.join(F.broadcast(total)).select("word", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def oov_counts(words: DataFrame, vocabulary: DataFrame, mincount: int = 1) -> DataFrame:
    """Counts of words outside the vocabulary, from ``mincount`` on, with a letter and no digit."""
    n = word_counts(words.join(vocabulary.select("word"), "word", "left_anti"))
    return n.filter((F.col("n") >= mincount) & F.col("word").rlike("(?i)[a-z]") & ~F.col("word").rlike("[0-9]"))


def oov_mass(words: DataFrame, vocabulary: DataFrame, mincount: int) -> DataFrame:
    """Tokens of unknown words that are rarer than ``mincount``."""
    n = word_counts(words.join(vocabulary.select("word"), "word", "left_anti"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") < mincount, F.col("n"))), F.lit(0)).alias("mass"))


def classify(ref: Column, hyp: Column, eps: str = "<eps>") -> Column:
    """Edit class of a pair: D, I, S or C."""
    return F.when(hyp == eps, "D").when(ref == eps, "I").when(ref != hyp, "S").otherwise("C")


def edit_counts(pairs: DataFrame, key: str = "utt") -> DataFrame:
    """Per utterance: correct, substituted, inserted, deleted."""
    op = classify(F.col("ref"), F.col("hyp"))
    return pairs.withColumn("op", op).groupBy(key).agg(*[F.count_if(F.col("op") == x.upper()).alias(x) for x in "csid"])


def wer_by_speaker(csid: DataFrame, utt2spk: DataFrame) -> DataFrame:
    """Sentences, words, counts and percent rates per speaker, with a SUM row over all; rates are null without words."""
    j = csid.join(utt2spk, "utt")
    err = F.col("s") + F.col("i") + F.col("d")
    r = j.rollup("spk").agg(F.count("*").alias("n_sent"), *[F.sum(x).alias(x) for x in "csid"], F.sum((err > 0).cast("long")).alias("sent_err"), F.grouping("spk").alias("_all"))
    r = r.withColumn("spk", F.when(F.col("_all") == 1, "SUM").otherwise(F.col("spk"))).drop("_all").withColumn("n_word", F.col("c") + F.col("s") + F.col("d")).withColumn("err", err)
    rate = lambda x: F.when(F.col("n_word") > 0, F.round(100.0 * F.col(x) / F.col("n_word"), 2))
    out = r.select("spk", "n_sent", "n_word", "c", "s", "i", "d", "err", "sent_err", *[rate(x).alias(f"{x}_pct") for x in ("c", "s", "i", "d", "err")], F.round(100.0 * F.col("sent_err") / F.col("n_sent"), 2).alias("sent_err_pct"))
    return out.filter("n_sent > 0")


def edit_op_table(pairs: DataFrame) -> DataFrame:
    """Count of each pair with its class."""
    names = F.create_map(*[F.lit(x) for x in ("C", "correct", "S", "substitution", "I", "insertion", "D", "deletion")])
    return pairs.groupBy("ref", "hyp").agg(F.count("*").alias("n")).withColumn("op", names[classify(F.col("ref"), F.col("hyp"))])


def wer_line(err: Column, words: Column, i: Column, d: Column, s: Column) -> Column:
    return F.format_string("%%WER %.2f [ %d / %d, %d ins, %d del, %d sub ]", 100.0 * err / words, err, words, i, d, s)


def best(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The row of the smallest ``by``; the first in ``order`` wins a tie."""
    row = F.min_by(F.struct("*"), F.struct(by, *order))
    return df.agg(row.alias("r")).select("r.*")


def lexicon_probs(observed: DataFrame, lexicon: DataFrame, smooth: float = 1.0, by_max: bool = True) -> DataFrame:
    """Smoothed probability of each entry (word, pron), over the word's largest or total; strange prons are an error."""
    n = observed.groupBy("word", "pron").agg(F.count("*").alias("n"))
    entries = lexicon.select("word", "pron").distinct().withColumn("_in", F.lit(True))
    j = entries.join(n, ["word", "pron"], "full")
    j = j.withColumn("n", F.when(F.col("_in"), F.coalesce("n", F.lit(0)) + smooth).otherwise(F.raise_error(F.concat(F.lit("not in lexicon: "), "word")).cast("double")))
    w = Window.partitionBy("word")
    return j.select("word", "pron", (F.col("n") / (F.max("n").over(w) if by_max else F.sum("n").over(w))).alias("prob"))


def pron_probs(lexicon: DataFrame, counts: DataFrame, max_normalize: bool = False) -> DataFrame:
    """Add-one probabilities of lexicon entries; with ``max_normalize`` over the word's best."""
    j = lexicon.select("word", "pron").join(counts, ["word", "pron"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1).filter("word <> '<eps>'")
    w = Window.partitionBy("word")
    p = j.withColumn("prob", F.col("n") / F.sum("n").over(w))
    return p.select("word", "pron", (F.col("prob") / F.max("prob").over(w) if max_normalize else F.col("prob")).alias("prob"))


def silence_neighbours(prons: DataFrame, sil: str = "SIL") -> DataFrame:
    """For each word-pron: times after and before silence and not, with ``<s>`` and ``</s>`` around each utterance.

    ``prons`` has utt, pos, word, pron; silences are rows of the word ``<eps>``. One sort by utterance serves both
    neighbours and the ends. The counts are written once, as the probabilities and factors made of them read them again.
    """
    from .helpers import store

    w = Window.partitionBy("utt").orderBy("pos")
    a = prons.select("word", "pron", F.lag("word").over(w).alias("_b"), F.lead("word").over(w).alias("_a"))
    row = lambda word, pron, b, a: F.struct(word.alias("word"), pron.alias("pron"), b.alias("_b"), a.alias("_a"))
    none, word, start, end = F.lit(None).cast("string"), F.col("word"), F.lit("<s>"), F.lit("</s>")
    rows = [
        F.when(word != "<eps>", row(word, F.col("pron"), F.coalesce("_b", start), F.coalesce("_a", end))),
        F.when(F.col("_b").isNull(), row(start, F.lit(""), none, word)),
        F.when(F.col("_a").isNull(), row(end, F.lit(""), word, none)),
    ]
    a = a.select(F.inline(F.array_compact(F.array(*rows))))
    sil_b, sil_a = F.col("_b") == "<eps>", F.col("_a") == "<eps>"
    counts = a.groupBy("word", "pron").agg(F.count_if(sil_b).alias("sil_before"), F.count_if(~sil_b).alias("nonsil_before"), F.count_if(sil_a).alias("sil_after"), F.count_if(~sil_a).alias("nonsil_after"))
    return store(counts, "silence")


def half_up(x: Column) -> Column:
    """Two decimals by plain arithmetic, which every engine does alike."""
    return F.floor(x * 100 + 0.5) / 100


def silence_probs(counts: DataFrame, weight: float = 2.0) -> DataFrame:
    """Probability of silence after and before each pron, drawn to the overall one by ``weight``, in [0.01, 0.99]."""
    real = F.when(~F.col("word").isin("<s>", "</s>"), F.lit(1)).otherwise(0)
    total = counts.agg((F.sum(F.col("sil_after") * real) / F.sum((F.col("sil_after") + F.col("nonsil_after")) * real)).alias("p"))
    p = lambda s, n: F.least(F.lit(0.99), F.greatest(F.lit(0.01), half_up((F.col(s) + F.col("p") * weight) / (F.col(s) + F.col(n) + weight))))
    return counts.join(F.broadcast(total)).select("word", "pron", p("sil_before", "nonsil_before").alias("p_before"), p("sil_after", "nonsil_after").alias("p_after"))  # one row


def silence_correction(probs: DataFrame, counts: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Factors by which silence before a word exceeds what its predecessors predict, smoothed by 2, at least 0.01.

    ``bigrams`` has v, w and n: times that pron w follows pron v, silences aside.
    """
    e = bigrams.join(probs.select(F.col("word").alias("v"), "p_after"), "v").groupBy("w").agg(F.sum(F.col("n") * F.col("p_after")).alias("cs"), F.sum(F.col("n") * (1 - F.col("p_after"))).alias("cn"))
    j = counts.join(e, F.col("word") == F.col("w"))
    f = lambda a, b: F.greatest(F.lit(0.01), half_up((F.col(a) + 2) / (F.round(b, 6) + 2)))
    return j.select("word", f("sil_before", "cs").alias("f_sil"), f("nonsil_before", "cn").alias("f_nonsil"))


def pron_counts(prons: DataFrame) -> DataFrame:
    """Count of each word with its phones, word-position suffixes removed."""
    bare = F.array_join(F.transform(F.split("pron", " "), lambda p: F.regexp_replace(p, "_[BISE]$", "")), " ")
    return prons.groupBy("word", bare.alias("pron")).agg(F.count("*").alias("n"))


def pron_report(observed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Observed prons of each word by rank, with share, whether the lexicon has them, and the lexicon's own."""
    n = observed.groupBy("word", "pron").agg(F.count("*").alias("n"))
    w = Window.partitionBy("word")
    ref = lexicon.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("pron")), " | ").alias("reference"))
    ok = lexicon.select("word", "pron", F.lit("CORRECT").alias("verdict")).distinct()
    n = n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "pron"))).withColumn("share", F.col("n") / F.sum("n").over(w))
    return n.join(ok, ["word", "pron"], "left").join(ref, "word", "left").withColumn("verdict", F.coalesce("verdict", F.lit("INCORRECT")))


def rule_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rule", "destress").agg(*[F.count_if(F.col("grade") == g).alias(g) for g in ("right", "partial", "wrong")])


def rule_scores(counts: DataFrame, ballast: float = 1.0, partial: float = 0.8) -> DataFrame:
    """(right + partial share) / (total + ballast), a hair less for destressed rules, to five decimals."""
    score = (F.col("right") + partial * F.col("partial")) / (F.col("right") + F.col("partial") + F.col("wrong") + ballast)
    return counts.select("rule", "destress", F.round(score - F.when(F.col("destress") == "yes", 1e-5).otherwise(0.0), 5).alias("score"))


def keyword_thresholds(hits: DataFrame, beta: float = 999.9, duration: float = 3600.0, scale: float = 1.0) -> DataFrame:
    """Decision threshold of each keyword from the expected number of true hits, duplicates included."""
    t = hits.groupBy("kwid").agg((F.lit(scale) * F.sum("score")).alias("n_true"))
    return t.withColumn("threshold", F.col("n_true") / (F.lit(duration / beta) + F.lit((beta - 1) / beta) * F.col("n_true")))


def speaker_stats(feats: DataFrame, by: str = "spk") -> DataFrame:
    """Count, sum and sum of squares of each dimension per speaker, one row a dimension: partial sums combine before the shuffle."""
    x = feats.select(by, F.posexplode("vec").alias("dim", "x"))
    return x.groupBy(by, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"))


def total_speech(segments: DataFrame) -> DataFrame:
    t = segments.agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return t.select(F.round("seconds", 2).alias("seconds"), F.round(F.col("seconds") / 3600, 6).alias("hours"), F.floor(F.round(F.col("seconds") * 100, 3)).alias("frames"))


def log_summary(logs: DataFrame) -> DataFrame:
    """Warnings, errors, processor and thread seconds of each log category (file, line; ``.N.`` in a name is a job number)."""
    cat = F.regexp_replace("file", r"\.\d+\.", ".*.")
    time, threads = F.regexp_extract("line", r"time=(\d+)", 1), F.regexp_extract("line", r"threads=(\d+)", 1)
    acc = F.col("line").rlike("^# Accounting:")
    return logs.groupBy(cat.alias("category")).agg(
        F.count_if(F.col("line").rlike("WARNING")).alias("warnings"), F.count_if(F.col("line").rlike("ERROR")).alias("errors"),
        F.sum(F.when(acc, time.cast("long") * threads.cast("long")).otherwise(0)).alias("cpu_seconds"), F.sum(F.when(acc, threads.cast("long")).otherwise(0)).alias("threads"),
    )
