"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .classes import one_row_each
from .common import LOWER, map_texts, sliced, store, table
from .components import connected_components

SEED = 42
#: Members of a candidate bucket compared in one task; a larger bucket is cut into blocks of this size.
BLOCK = 1024


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a whole text: bit i is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), last.tolist()))
    for at in range(0, n, 8192):  # the bit matrix stays small for very long texts
        h = np.array([digest(joined[i:j], SEED) for i, j in spans[at : at + 8192]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), in one narrow pass."""

    def work(texts: list) -> list:
        return [signed_fingerprints(texts, width)]

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(cols, lambda: work, "doc_id long, fp long", 1)


def signed_fingerprints(texts: list, width: int) -> np.ndarray:
    return np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)


def segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """Cut ``bits`` into ``parts`` nearly equal consecutive (first bit, width)."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def ring_keys(limit: int) -> list[int]:
    """Bit masks under which two linked fingerprints must agree, for at least one of them.

    The fingerprint is a ring of m = limit + 1 segments. Linked fingerprints differ in at most ``limit`` bits,
    so from some segment on, every chain of l consecutive segments differs in at most l * limit / m bits,
    rounded down: the first segment in none, two in one, three in two. For that start, the second and third
    segment together hold at most two differences; cut into four parts, at least two of the parts agree. A
    mask is the first segment and two of the four parts: 26 of 64 bits at limit 4, and 30 masks.
    """
    m = limit + 1
    ring = segments(64, m)
    masks = []
    span = min(3, m) - 1  # segments after the first that are cut into parts
    for i in range(m):
        base = sum(1 << (ring[i][0] + k) for k in range(ring[i][1]))
        later = [ring[(i + s) % m][0] + k for s in range(1, span + 1) for k in range(ring[(i + s) % m][1])]
        slack = (span + 1) * limit // m
        parts = [later[a : a + w] for a, w in segments(len(later), slack + 2)]
        for keep in combinations(parts, 2):
            masks.append(base | sum(1 << b for part in keep for b in part))
    return masks


def ring_ok(x: np.ndarray, limit: int) -> np.ndarray:
    """Whether some start keeps every chain of consecutive segments of the difference within its budget.

    The chain of all segments is the whole ring, so what passes differs in at most ``limit`` bits: the full Hamming
    check is the last step of the chain. Differences are dropped as soon as every start has failed.
    """
    m = limit + 1
    ring = [np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int16) for a, w in segments(64, m)]
    ok = np.zeros(x.shape, bool)
    for i in range(m):
        chain, viable = np.zeros(x.shape, np.int16), np.ones(x.shape, bool)
        for step in range(1, m + 1):
            chain = chain + ring[(i + step - 1) % m]
            viable &= chain <= step * limit // m
            if not viable.any():
                break
        ok |= viable
    return ok


def ring_passes(x: Column, limit: int) -> Column:
    """As :func:`ring_ok`, as a column."""
    m = limit + 1
    ring = [F.bit_count(F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << w) - 1))) for a, w in segments(64, m)]
    out = F.lit(False)
    for i in range(m):
        chain, viable = F.lit(0), F.lit(True)
        for step in range(1, m + 1):
            chain = chain + ring[(i + step - 1) % m]
            viable = viable & (chain <= step * limit // m)
        out = out | viable
    return out


def bucket_links(key: np.ndarray, side: np.ndarray, group: np.ndarray, fp: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of fingerprints of different groups within each run of equal keys, enough to connect all that are connected.

    Small buckets are compared all at once, shift by shift. In a large one each member is compared with a row of
    seeds, and members that have joined a seed's group need no comparison with others of that group.
    """
    out = []
    n = len(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    small = sizes <= 24
    inside = np.repeat(small, sizes)
    for shift in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & inside[shift:] & ((side[shift:] | side[:-shift]) == 3) & (group[shift:] != group[:-shift]))
        d = fp[i] ^ fp[i + shift]
        i = i[np.bitwise_count(d) <= 3 * limit]  # a coarse look first: most differ in half of their bits
        i = i[ring_ok(fp[i] ^ fp[i + shift], limit)]
        out.append((fp[i], fp[i + shift]))
    for s, size in zip(starts[~small], sizes[~small]):
        own = slice(s, s + size)
        out += large_bucket(side[own], group[own], fp[own], limit)
    return out


def large_bucket(side: np.ndarray, group: np.ndarray, fp: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one large bucket, with groups relabelled as they grow."""
    out = []
    group = group.copy()
    for i in range(len(fp)):
        rest = np.flatnonzero((group != group[i]) & ((side | side[i]) == 3))
        if not len(rest):
            continue
        rest = rest[ring_ok(fp[rest] ^ fp[i], limit)]
        if len(rest):
            _, first = np.unique(group[rest], return_index=True)  # one link to each other group
            rest = rest[first]
            out.append((np.full(len(rest), fp[i]), fp[rest]))
            group[np.isin(group, group[rest])] = group[i]
    return out


def star_links(rows: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) of every member of a bucket (fp, key) with the bucket's least member, where they are within ``limit`` bits."""
    seeds = store(rows.groupBy("key").agg(F.min("fp").alias("a")), "seeds")
    pairs = rows.join(seeds.hint("merge"), "key").filter(F.col("a") != F.col("fp"))
    return pairs.filter(ring_passes(F.col("a").bitwiseXOR(F.col("fp")), limit)).select("a", F.col("fp").alias("b")).distinct()


def fingerprint_links(fps: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints with at most ``limit`` differing bits, enough to connect.

    Every fingerprint goes to one bucket per ring mask; buckets of one are dropped after a partial count. A bucket
    of more than ``block`` members is first compared with its least member only, which links most of a large group
    of near-copies at one comparison each; a bucket that falls into one group by this is done. What is left of it
    is dealt into blocks by a hash, the group of the least member apart from the others, and pairs of blocks are
    compared, but for those of the first group among themselves. So no task holds more than two blocks of any
    bucket, every pair of different groups still meets once per shared mask, and the copies of a member grow with
    the members outside the first group only.
    """
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in ring_keys(limit)])
    rows = fps.select("fp", F.posexplode(masks).alias("mask", "bits")).select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("bits"))).alias("key"))
    sizes = store(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    small = rows.join(sizes.filter(F.col("n") <= block).select("key").hint("merge"), "key")
    small = small.select("fp", F.col("key").alias("bucket"), F.lit(3).cast("byte").alias("side"), F.col("fp").alias("group"))
    hot = sizes.filter(F.col("n") > block)
    if hot.isEmpty():
        return compared(small, limit).distinct()

    large = store(rows.join(hot.select("key").hint("merge"), "key", "left_semi"), "large")
    stars = store(star_links(large, limit), "stars")
    groups = connected_components(stars).select(F.col("node").alias("fp"), "component")
    members = store(large.join(groups.hint("merge"), "fp", "left").select("fp", "key", F.coalesce("component", "fp").alias("group")), "members")
    first = members.groupBy("key").agg(F.min_by("group", "fp").alias("lead"), F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    left = store(members.join(store(first.select("key", "lead"), "open").hint("merge"), "key"), "left")
    counts = left.groupBy("key").agg(F.count(F.when(F.col("group") == F.col("lead"), 1)).alias("in"), F.count(F.when(F.col("group") != F.col("lead"), 1)).alias("out"))
    parts = store(counts.select("key", F.ceil(F.col("in") / block).cast("int").alias("ins"), F.ceil(F.col("out") / block).cast("int").alias("outs")), "parts")
    left = left.join(parts.hint("merge"), "key").withColumn("is_in", F.col("group") == F.col("lead"))
    dealt = F.xxhash64("fp", F.lit(1))
    own = F.when(F.col("is_in"), F.pmod(dealt, F.col("ins"))).otherwise(F.col("ins") + F.pmod(dealt, F.col("outs"))).cast("int")
    others = F.sequence(F.when(F.col("is_in"), F.col("ins")).otherwise(0), F.col("ins") + F.col("outs") - 1)
    left = left.select("fp", "key", "group", own.alias("own"), F.explode(others).alias("other"))
    # side: 3 compares with all (one block), 1 and 2 with the other block only
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    bucket = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rest = left.select("fp", bucket.alias("bucket"), side.cast("byte").alias("side"), "group")
    return compared(small.unionByName(rest), limit).unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def compared(rows: DataFrame, limit: int) -> DataFrame:
    """Links within buckets of rows (fp, bucket, side, group), streamed bucket by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b])
            key = b["bucket"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            held = b.iloc[cut:]
            yield links(b.iloc[:cut])
        if held is not None:
            yield links(held)

    def links(b: pd.DataFrame) -> pd.DataFrame:
        cols = [b[c].to_numpy() for c in ("bucket", "side", "group")]
        found = bucket_links(*cols, b["fp"].to_numpy().view(np.uint64), limit) if len(b) > 1 else []
        one, two = (np.concatenate([f[k] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)}).drop_duplicates()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "a long, b long")


def classes_of(prints: DataFrame, limit: int) -> DataFrame:
    """Class of each distinct fingerprint of ``prints`` (doc_id, fp): fp, root (the class) and component_id (its smallest doc_id)."""
    fps = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = store(fingerprint_links(fps.select("fp"), limit), "links")
    groups = connected_components(links)
    named = store(fps.join(groups.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "named")
    roots = store(named.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    return store(named.join(roots.hint("merge"), "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, *, width: int = 4, limit: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SimHash classes of all documents: doc_id, fingerprint (16 hex digits), component_id.

    Exact copies meet in one row per fingerprint before any candidate is made. Fingerprints link at ``limit``
    or fewer differing bits, found through the pigeonring masks of :func:`ring_keys` and the chain condition,
    whose last step is the Hamming distance; components follow links of any length. component_id is the
    smallest doc_id of the component.

    Null and empty texts have fingerprint zero and link like any other; a text of fewer words than a shingle is
    one shingle; a very long text is hashed whole, in blocks; repeated rows are copies; a null doc_id keeps a row
    and never names a component, which is null where all its ids are; an empty table gives an empty result. Only
    the two named columns are read, so other columns may have any name.
    """
    prints = store(fingerprints(docs, width, id_col, text_col), "fps")
    out = prints.join(classes_of(prints, limit).hint("merge"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, width: int, text_col: str, name: str) -> DataFrame:
    """``docs`` with one more column, the fingerprint as a signed long."""
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            fp = pa.array(signed_fingerprints(b.column(at).to_pylist(), width))
            yield pa.RecordBatch.from_arrays([*b.columns, fp], [*b.schema.names, name])

    return docs.mapInArrow(add, StructType([*docs.schema, StructField(name, LongType())]))


def drop_near_duplicates(docs: DataFrame, *, width: int = 4, limit: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of :func:`near_duplicates`, that of the smallest doc_id, all columns unchanged.

    Null, empty, short and very long texts are treated as there; repeated rows, ties and rows without an id are
    settled by :func:`.classes.one_row_each`; an empty table gives an empty result; columns of any name pass
    through.
    """
    classes = classes_of(store(fingerprints(docs, width, id_col, text_col), "fps"), limit).withColumnRenamed("fp", "key")
    return one_row_each(docs, classes, lambda df, name: with_fingerprint(df, width, text_col, name), id_col, text_col)


def op4_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
