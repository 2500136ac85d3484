"""Near-copies of documents: SimHash and MinHash candidates, held to the exact similarity of word shingles.

The pipeline's form of the near-duplicate operator. SimHash fingerprints that link through the pigeonring filter are
compared exactly, and so are sets that share a MinHash band: fingerprints of texts whose 5-word shingles have a
similarity of 0.8 differ in up to 14 of 64 bits, beyond any selective ring filter, so SimHash alone loses links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .classes import one_row_each
from .common import LOWER, distinct, join_checked, sliced, store
from .components import connected_components
from .simhash import fingerprint_links

#: MinHash bands and their rows: at similarity 0.8 a pair shares no band once in 14,000 pairs, at 0.9 once in 10**9.
BANDS, ROWS = 24, 5
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
#: Documents worked on at once in a task, members of a bucket that are compared at once, and shingles of theirs.
BLOCK, MEMBERS, COLUMNS = 256, 512, 4096


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out = out * MULTIPLIER + h[i : i + n]
    return distinct(mixed(out))


def set_key(s: np.ndarray) -> int:
    """Name of a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed long: a bit is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), 8192):  # the bit matrix stays small for very long texts
        counts += np.unpackbits(s[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(s), bitorder="little").view("<i8")[0])


def band_keys(s: np.ndarray) -> np.ndarray:
    """One signed long for each band of the MinHash signature of a shingle set."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    s32 = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(s32), 512):  # the table of permuted values stays in the cache
        low = np.minimum(low, (s32[at : at + 512, None] * _A + _B).min(axis=0))
    out = np.arange(1, BANDS + 1).astype(np.uint64)
    for row in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = mixed(out * MULTIPLIER + row)
    return out.view(np.int64)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (its shingle set), n (the set's size), fp (its SimHash) and the bands b0, b1, ..., in one narrow pass."""
    names = [f"b{i}" for i in range(BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                bands = np.array([band_keys(s) for s in sets]).T
                cols = [part.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_fingerprint(s) for s in sets], pa.int64()), *map(pa.array, bands)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "fp", *names])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, f"doc_id long, key long, n long, fp long, {', '.join(f'{x} long' for x in names)}")


def with_key(docs: DataFrame, width: int, text_col: str, name: str) -> DataFrame:
    """``docs`` with one more column, the key of the shingle set."""
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            texts = b.column(at).to_pylist()
            key = pa.array([set_key(shingle_set(t, width)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, key], [*b.schema.names, name])

    return docs.mapInArrow(add, StructType([*docs.schema, StructField(name, LongType())]))


def shingle_sets(docs: DataFrame, keys: DataFrame, width: int, text_col: str) -> DataFrame:
    """key, its shingle set and the upper halves of the hashes, for the stored ``keys`` only: texts are dropped before sets are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                sets = [shingle_set(t, width).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                short = [(x.view(np.uint64) >> np.uint64(32)).astype("<u4").tobytes() for x in sets]
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "shingles", "short"])

    keyed = with_key(docs.select(F.col(text_col).alias("text")), width, "text", "key")
    texts = join_checked(keyed, keys, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return texts.mapInArrow(run, "key long, shingles array<long>, short binary")


def similar(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``share`` (over, under)."""
    over, under = share
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
    both = both.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter((over + under) * common >= over * (F.size("sa") + F.size("sb"))).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; equal hashes of different shingles can only make them larger."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1  # the others are in one set only
    column, place = np.cumsum(often) - 1, often[which]
    owner, which = owner[place], column[which[place]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(which, [at, at + COLUMNS])
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[owner[i:j], which[i:j] - at] = 1
        out += holds @ holds.T
    return out


def like_pairs(members: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different groups in a bucket of ``members`` (bucket, key, n, group) that may be similar.

    A task streams its buckets and compares all members of one at once, on the upper halves of the shingle hashes,
    so it emits hardly any pair that is not similar. A bucket of more than ``MEMBERS`` is dealt into blocks by a
    hash, and each pair of blocks is a bucket of its own, so a task's memory is bounded.
    """
    over, under = share
    sizes = store(members.groupBy("bucket").agg(F.count("*").alias("size")), "sizes")
    blocks = F.ceil(F.col("size") / MEMBERS).cast("int")
    rows = members.join(sizes.hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # side: 3 compares with all (one block), 1 and 2 with the other block only
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), side.alias("side"), "key", "n", "group")
    rows = rows.join(sets.select("key", "short").hint("merge"), "key").select("bucket", "side", "key", "n", "group", "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            bucket = t["bucket"].to_numpy()
            cuts = [*np.flatnonzero(np.diff(bucket, prepend=bucket[0] ^ 1)).tolist(), len(bucket)]
            for i, j in zip(cuts[:-2], cuts[1:-1]):  # the last bucket may go on in the next batch
                yield found(t.slice(i, j - i))
            held = t.slice(cuts[-2])
        if held is not None:
            yield found(held)

    def found(t: pa.Table) -> pa.RecordBatch:
        side, key, n, group = (t[c].to_numpy() for c in ("side", "key", "n", "group"))
        ok = (group[:, None] != group) & (over * np.maximum(n[:, None], n) <= under * np.minimum(n[:, None], n)) & (side[:, None] | side == 3) & (key[:, None] < key)
        if ok.any():
            common = overlaps([np.frombuffer(x, "<u4") for x in t["short"].to_pylist()])
            ok &= (over + under) * common >= over * (n[:, None] + n)
        a, b = np.nonzero(ok)
        return pa.RecordBatch.from_pydict({"a": pa.array(key[a]), "b": pa.array(key[b])})

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def hubs(members: DataFrame) -> DataFrame:
    """The hub of each bucket of ``members`` (bucket, key): of its sets, that which shares buckets with the most others."""
    sizes = store(members.groupBy("bucket").agg(F.count("*").alias("size")), "sizes")
    degrees = store(members.join(sizes.hint("merge"), "bucket").groupBy("key").agg(F.sum("size").alias("degree")), "degrees")
    return store(members.join(degrees.hint("merge"), "key").groupBy("bucket").agg(F.max_by("key", F.struct("degree", "key")).alias("hub")), "hubs")


def pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def fingerprint_pairs(one: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of the sets ``one`` (key, fp) that SimHash links at ``limit`` or fewer bits, enough to connect them.

    The least set of a fingerprint stands for it: it is paired with the others of the fingerprint and with those that
    stand for linked fingerprints.
    """
    least = store(one.groupBy("fp").agg(F.min("key").alias("rep")), "fingerprints")
    links = store(fingerprint_links(least.select("fp"), limit), "fingerprint-links")
    side = lambda x: least.select(F.col("fp").alias(x), F.col("rep").alias(f"r{x}")).hint("merge")
    apart = links.join(side("a"), "a").join(side("b"), "b").select(*pair("ra", "rb"))
    same = one.select("key", "fp").join(least.hint("merge"), "fp").filter(F.col("key") != F.col("rep")).select(*pair("key", "rep"))
    return apart.unionByName(same).distinct()


def near_copy_classes(docs: DataFrame, prints: DataFrame, width: int, share: tuple[int, int], text_col: str, limit: int = 4) -> DataFrame:
    """Class of each distinct shingle set of ``prints``: key, root (the class) and component_id (its smallest doc_id).

    Sets whose fingerprints link at ``limit`` bits (:func:`fingerprint_pairs`) and sets that share a band of their
    signatures are candidates, and link if their exact similarity is ``share`` or more. First every set is compared
    with its fingerprint's partners and with the hubs of its buckets: copies that were changed in different places
    are less like each other than like what they were copied from, which shares more buckets than any of them.
    Buckets that fall into one class by this are done, so a large group of copies mostly costs a few comparisons for
    each member. In the others all pairs of different classes are compared within tasks (:func:`like_pairs`), and
    no pair of a bucket is left out.
    """
    names = [f"b{i}" for i in range(BANDS)]
    one = store(prints.groupBy("key").agg(F.min("doc_id").alias("first"), *[F.any_value(x).alias(x) for x in ("n", "fp", *names)]), "sets")
    rows = one.select("key", "n", F.explode(F.array(*names)).alias("bucket"))
    # stored sides: a join on fresh exchanges can be split where a bucket or a class is large
    shared = store(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket"), "buckets")
    shared = store(rows.join(shared.hint("merge"), "bucket"), "shared")
    near = store(fingerprint_pairs(one, limit), "near")
    met = shared.select("key").unionByName(near.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    sets = store(shingle_sets(docs, store(met, "candidates"), width, text_col), "shingles")

    hub = hubs(shared)
    stars = shared.join(hub.hint("merge"), "bucket").filter(F.col("key") != F.col("hub")).select(*pair("key", "hub"))
    stars = store(stars.unionByName(near).distinct(), "stars")
    links = store(similar(stars, sets, share), "links")
    groups = connected_components(links).select(F.col("node").alias("key"), "component")
    members = store(shared.join(groups.hint("merge"), "key", "left").select("bucket", "key", "n", F.coalesce("component", "key").alias("group")), "members")
    open_ = members.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("bucket")
    left = store(members.join(store(open_, "open").hint("merge"), "bucket", "left_semi"), "rest")
    pairs = store(like_pairs(left, sets, share), "pairs")

    groups = connected_components(store(links.unionByName(similar(pairs, sets, share)), "links"))
    named = one.select("key", "first").join(groups.hint("merge"), F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("root"))
    named = store(named, "named")
    roots = store(named.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    return named.join(roots.hint("merge"), "root").select("key", "root", "component_id")


def drop_near_copies(docs: DataFrame, *, width: int = 5, share: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near-copies, that of the smallest doc_id, all columns unchanged.

    Documents link if the Jaccard similarity of their sets of ``width``-word shingles is ``share`` or more, and
    classes follow links of any length. Null and empty texts have the empty set and are copies of each other; a
    text of fewer words than a shingle is one shingle; a very long text is one set, the unit of memory. Repeated
    rows, ties and rows without an id are settled by :func:`.classes.one_row_each`; an empty table gives an empty
    result; columns of any name pass through.
    """
    prints = store(signatures(docs, width, id_col, text_col), "prints")
    classes = store(near_copy_classes(docs, prints, width, share, text_col), "classes")
    return one_row_each(docs, classes, lambda df, name: with_key(df, width, text_col, name), id_col, text_col)
