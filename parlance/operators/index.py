"""A stored inverted index over time-marked words: postings in sorted, delta-coded blocks that searches read by word and range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .helpers import numbered, range_join, small, store

#: Postings of a block.
BLOCK = 4096
FIELDS = ("utts", "places", "starts", "durations")
BLOCKS = "word string, first long, first_pos long, last long, n long, " + ", ".join(f"{f} binary" for f in FIELDS)


def build_index(ctm: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write the index of words (utt, pos, start, dur, word) under ``path``: a table of utterances and one of blocks.

    Utterances are numbered in order. A block holds up to ``block`` postings of one word: numbers of utterances as
    differences, places, starts and durations in centiseconds; beside them stand the first and the last utterance,
    by which a search skips blocks unread. Blocks come from a range-partitioned sort by word, utterance and place,
    so a word of any frequency is spread over as many tasks as it needs, files are ranges of words, and the
    files' statistics leave out those without a wanted word.
    """
    spark = ctm.sparkSession
    numbered(ctm.select("utt").distinct(), ["utt"], "u").write.parquet(f"{path}/utterances")
    utts = spark.read.parquet(f"{path}/utterances")
    cs = lambda x: F.round(F.col(x) * 100).cast("int")
    rows = ctm.join(small(utts), "utt").select("word", "u", F.col("pos").cast("int").alias("pos"), cs("start").alias("start_cs"), cs("dur").alias("dur_cs"))
    order = ["word", "u", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, held = None, [np.zeros(0, np.int64)] * 4

        def blocks(final: bool) -> Iterator[tuple]:
            nonlocal held
            while len(held[0]) >= block or (final and len(held[0])):
                u, *rest = (x[:block] for x in held)
                held = [x[block:] for x in held]
                yield (word, int(u[0]), int(rest[0][0]), int(u[-1]), len(u), np.diff(u, prepend=u[0]).astype("<u4").tobytes(), *(x.astype("<i4").tobytes() for x in rest))

        def packed(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), *[pa.int64()] * 4, *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

        for b in batches:
            runs = b.column(0).dictionary_encode()
            code = runs.indices.to_numpy()
            values = [b.column(i).to_numpy().astype(np.int64) for i in range(1, 5)]
            edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else [0]
            found = []
            for i, j in zip(edges[:-1], edges[1:]):
                own = runs.dictionary[int(code[i])].as_py()
                if own != word:
                    found += blocks(True)
                    word = own
                held = [np.concatenate([x, v[i:j]]) for x, v in zip(held, values)]
                found += blocks(False)
            if found:
                yield packed(found)
        if rest := list(blocks(True)):
            yield packed(rest)

    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def postings(blocks: DataFrame) -> DataFrame:
    """Postings (word, u, pos, start_cs, end_cs) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                word, first, _, _, n, u, pos, start, dur = (b.column(k)[i].as_py() for k in range(9))
                u = first + np.cumsum(np.frombuffer(u, "<u4").astype(np.int64))
                pos, start, dur = (np.frombuffer(x, "<i4").astype(np.int64) for x in (pos, start, dur))
                yield pa.RecordBatch.from_arrays([pa.array([word] * n, pa.string()), *map(pa.array, (u, pos, start, start + dur))], ["word", "u", "pos", "start_cs", "end_cs"])

    return blocks.select(*[x.split()[0] for x in BLOCKS.split(", ")]).mapInArrow(run, "word string, u long, pos long, start_cs long, end_cs long")


def blocks_of(spark: SparkSession, path: str, words: DataFrame, most: int = 1000) -> DataFrame:
    """Blocks of the listed words (word). Up to ``most`` words (counted) are a filter that the files' statistics answer."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    listed = [r[0] for r in words.limit(most + 1).collect()]
    return blocks.filter(F.col("word").isin(listed)) if len(listed) <= most else blocks.join(small(words), "word", "left_semi")


def search_index(spark: SparkSession, path: str, keywords: DataFrame, max_gap: float = 0.5, few: int = 4) -> DataFrame:
    """Phrase hits (kwid, utt, tbeg, dur) of keywords (kwid, text) from a stored index: each next word follows within ``max_gap``.

    A phrase starts from its rarest word, by the blocks' counts; its other words are looked up outwards from there. Postings
    meet the distinct stretches of phrases, so a place is one row however many keywords hold its word. Where a
    stretch goes on with few words, only blocks are decoded whose range of utterances holds a hit so far.
    """
    gap = round(max_gap * 100)
    k = store(keywords.select("kwid", F.split("text", " ").alias("w")).withColumn("n", F.size("w")), "keywords")
    wanted = k.select(F.explode("w").alias("word")).distinct()
    blocks = store(blocks_of(spark, path, wanted), "blocks")  # of the keywords' words; still coded
    sizes = blocks.groupBy("word").agg(F.sum("n").alias("size"))
    each = k.select("kwid", "w", "n", F.posexplode("w").alias("i", "word")).join(small(sizes), "word")
    # a phrase with a word that never occurs has no hits: all its words must be there
    rarest = each.groupBy("kwid", "w", "n").agg(F.min_by("i", F.struct("size", "i")).alias("i"), F.count("*").alias("there")).filter("there = n").drop("there")
    # words in the order of look-up: the rarest, those before it backwards, those after it
    way = F.concat(F.reverse(F.slice("w", F.lit(1), F.col("i") + 1)), F.slice("w", F.col("i") + 2, F.col("n")))
    k = store(rarest.select("kwid", "n", "i", way.alias("way")), "rarest")
    lengths = sorted(r[0] for r in k.select("n").distinct().collect())  # a few numbers
    seen = lambda s: F.array_join(F.slice("way", 1, s), " ")
    starts = postings(blocks.join(small(k.select(F.col("way")[0].alias("word")).distinct()), "word", "left_semi"))
    hit = starts.join(small(k.select(F.col("way")[0].alias("word"), "i").distinct()), "word").select(F.col("word").alias("seen"), "i", "u", "pos", "start_cs", "end_cs")
    done = hit.limit(0).select(F.lit(None).cast(k.schema["kwid"].dataType).alias("kwid"), "u", "start_cs", "end_cs")
    for s in range(1, (lengths or [0])[-1] + 1):
        if s > 1:
            steps = store(k.filter(F.col("n") >= s).select("i", seen(s - 1).alias("seen"), F.get("way", F.lit(s - 1)).alias("word"), seen(s).alias("more")).distinct(), "steps")
            back = F.col("i") >= s - 1  # first towards the beginning, then towards the end
            hit = store(hit.withColumn("at", F.when(back, F.col("pos") - 1).otherwise(F.col("pos") + s - 1)), "hits")
            fan = steps.groupBy("i", "seen").count().agg(F.max("count")).first()[0] or 0
            if fan <= few:
                near = range_join(hit.join(small(steps), ["i", "seen"]).select("word", "u").distinct(), blocks, ["word"], "u", "first", "last", 256)
                near = near.filter("u >= first and u <= last").dropDuplicates(["word", "first", "first_pos"])
            else:
                near = blocks.join(small(steps.select("word").distinct()), "word", "left_semi")
            nxt = postings(near).select("word", "u", F.col("pos").alias("at"), F.col("start_cs").alias("s2"), F.col("end_cs").alias("e2"))
            apart = F.when(back, F.col("start_cs") - F.col("e2")).otherwise(F.col("s2") - F.col("end_cs"))
            both = hit.join(nxt, ["u", "at"]).filter(apart <= gap).join(small(steps), ["i", "seen", "word"])
            hit = both.select(
                F.col("more").alias("seen"), "i", "u", F.when(back, F.col("at")).otherwise(F.col("pos")).alias("pos"),
                F.when(back, F.col("s2")).otherwise(F.col("start_cs")).alias("start_cs"), F.when(back, F.col("end_cs")).otherwise(F.col("e2")).alias("end_cs"),
            )
        if s in lengths:
            ids = small(k.filter(F.col("n") == s).select("kwid", "i", seen(s).alias("seen")))
            done = done.unionByName(hit.join(ids, ["i", "seen"]).select("kwid", "u", "start_cs", "end_cs"))
    utts = spark.read.parquet(f"{path}/utterances")
    out = done.join(utts, "u")
    return out.select("kwid", "utt", (F.col("start_cs") / 100).alias("tbeg"), F.round((F.col("end_cs") - F.col("start_cs")) / 100, 2).alias("dur"))
