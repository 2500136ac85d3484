"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, fresh, join_checked, store, table

WIDTH, CONTAINMENT = 5, 0.8


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_rows(df: DataFrame, *keys: str, width: int = WIDTH) -> DataFrame:
    """One row per shingle of column ``w``: the keys and ``shingle``. A text shorter than a shingle is one shingle.

    The word array is laid beside its own shifts and inlined, so that joining the words is compiled code.
    """
    n = F.size("w")
    names = [f"w{i}" for i in range(width)]
    long = F.arrays_zip(*[F.slice("w", F.lit(i + 1), F.greatest(n - F.lit(width - 1), F.lit(0))).alias(k) for i, k in enumerate(names)])
    short = F.array(F.struct(F.array_join("w", " ").alias("w0"), *[F.lit(None).cast("string").alias(k) for k in names[1:]]))
    rows = df.filter(n > 0).select(*keys, F.inline(F.when(n >= width, long).otherwise(short)))
    return rows.select(*keys, F.concat_ws(" ", *names).alias("shingle"))


def least_shared(n: Column, containment: float) -> Column:
    """Fewest shingles of ``n`` that make up the containment; the margin undoes binary rounding."""
    return F.ceil(n * F.lit(containment) - F.lit(1e-9)).cast("long")


def signatures(items: DataFrame, containment: float) -> DataFrame:
    """MinHash signatures of items (item_id, shingle): each item's smallest hashes, as many as its size class needs.

    Items are partitioned by size: class k holds items of 2**k to 2**(k+1) - 1 shingles, and u is the largest
    size in the class. A document with a share t of an item's n shingles misses at most n - ceil(t n) of them,
    so of any n - ceil(t n) + 1 it has one; the signature is the floor((1 - t) u) + 1 smallest hashes (all, if
    the item has fewer). A document that shares none of them cannot contain the item, so nothing is lost.
    """
    hashed = items.select("item_id", "shingle", F.xxhash64("shingle").alias("h"))
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n")).withColumn("size_class", F.floor(F.log2("n")))
    classes = sizes.groupBy("size_class").agg(F.max("n").alias("u"))
    keep = sizes.join(classes, "size_class").select("item_id", "n", "size_class", (F.col("u") - least_shared(F.col("u"), containment) + 1).alias("k"))
    ranked = hashed.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))  # a test item is short
    return ranked.join(keep, "item_id").select("item_id", "n", "size_class", F.explode(F.slice("hs", 1, F.col("k").cast("int"))).alias("h"))


def contained_items(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Pairs of a document and a test item it contains: doc_id, item_id, n_item, n_shared, containment.

    An item is contained when the document has at least ``containment`` of its distinct ``width``-word shingles
    (lower-cased A-Z, words between ASCII white space). Documents' shingle hashes meet the items' MinHash
    signatures (:func:`signatures`); each candidate document is then checked shingle by shingle.

    Signatures are broadcast only if their counted rows are few, else both sides are shuffled. A passage that
    many documents share is one row each, never a pair of documents. Texts without words have no shingles and
    contain nothing; an item without words is in no document; a text of fewer than ``width`` words is one
    shingle, so an item that short is found in a document that is the same, not inside a longer one. Null ids are
    dropped (a pair could not name them); repeated rows and rows of one id are one document; a very long text is one
    array of words; either table may be empty. Only the named columns are read, so others may have any name.
    """
    spark_items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("w")).filter("item_id is not null")
    items = store(shingle_rows(spark_items, "item_id", width=width).distinct(), "items")
    signs = store(signatures(items, containment), "signatures")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")

    hashes = shingle_rows(d.select("doc_id", words(F.col("text")).alias("w")), "doc_id", width=width).select("doc_id", F.xxhash64("shingle").alias("h"))
    candidates = store(join_checked(hashes, signs.select("item_id", "h"), "h").select("doc_id", "item_id").distinct(), "candidates")

    named = store(candidates.select("doc_id").distinct(), "named")
    suspects = store(join_checked(d, named, "doc_id", "left_semi"), "suspects")  # few: their words are split from what was written
    have = shingle_rows(suspects.select("doc_id", words(F.col("text")).alias("w")), "doc_id", width=width)
    wanted = items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    # a suspect's shingles that belong to items, then only the pairs that are candidates
    shared = join_checked(have, items, "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    pairs = join_checked(shared.join(candidates, ["doc_id", "item_id"], "left_semi"), store(wanted, "sizes"), "item_id")
    return pairs.filter(F.col("n_shared") >= least_shared(F.col("n_item"), containment)).select(
        "doc_id", "item_id", "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, that contain no test item by :func:`contained_items`.

    Rows of one id are one document and go together; rows without an id cannot be named and stay, as do null and
    empty texts; either table may be empty; columns of any name pass through.
    """
    leak = fresh(docs.columns, "_leak")
    found = contained_items(docs, benchmark, containment=containment, id_col=id_col, text_col=text_col)
    return join_checked(docs, store(found.select(F.col("doc_id").alias(leak)).distinct(), "leaks"), F.col(f"`{id_col}`").cast("long") == F.col(leak), "left_anti")


def op1_decontaminate(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, n.n AS n_item, count(*) AS n_shared, round(count(*) / n.n, 6) AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.id = bs.id GROUP BY ds.id, bs.id, n.n HAVING count(*) >= ceil(0.8 * n.n - 1e-9)
"""
