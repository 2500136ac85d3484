"""Filters, key maps and row-wise transforms of corpus tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .helpers import SMALL, lookup, numbered, ordered_list, seeded, small, store


def filter_by_ids(df: DataFrame, ids: DataFrame, on: str, id_col: str | None = None, exclude: bool = False) -> DataFrame:
    """Rows whose key is (or, with ``exclude``, is not) listed. Repeated rows stay; repeated ids do no harm."""
    keys = ids.select(F.col(id_col or ids.columns[0]).alias(on))
    return df.join(keys, on, "left_anti" if exclude else "left_semi")


def filter_by_many_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """One pass for many id lists: ``ids`` has the key and ``job``; each row appears once for each job that lists it."""
    return df.join(ids.select(on, "job").distinct(), on)


def one_each(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key of a look-up table: a row listed twice counts once, two values for one key are an error; null keys go."""
    least, most = F.min(value), F.max(value)
    kind = dict(table.dtypes)[value]
    clash = F.raise_error(F.concat(F.lit(f"two entries for {key} "), F.col(key).cast("string"))).cast(kind)
    return table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.when(least.eqNullSafe(most), least).otherwise(clash).alias(value))


def map_tokens(df: DataFrame, mapping: DataFrame, key: str, tokens: str, first: int = 1, last: int | None = None, permissive: bool = False, in_place: int = SMALL) -> DataFrame:
    """Replace tokens at positions ``first`` to ``last`` by the mapped token lists (columns sym, values).

    A token without an entry is an error, or stays with ``permissive``; a null token stays null. An entry listed twice
    counts once, and one with two values is an error. Rows without tokens keep an empty list; repeated keys are rows of
    their own. A mapping of at most ``in_place`` entries (counted) is looked up in place, without a shuffle; a larger
    one is joined, with the same results.
    """
    last = last if last is not None else 1 << 30
    mapping = one_each(mapping.select("sym", "values"), "sym", "values")
    table = lookup(mapping, in_place)
    if table is not None:
        return mapped_in_place(df.select(key, tokens), table, first, last, permissive)
    return in_blocks(df.select(key, tokens), mapping, "sym", lambda b, t: mapped(b, mapping_arrays(t), first, last, permissive), f"`{tokens}` array<string>")


def numbered_rows(df: DataFrame) -> DataFrame:
    """``df`` with a number for each row, written down so that a repeated task sees the same."""
    return store(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


#: Rows of a block that is looked up at once, and the tokens beyond which a row is a block of its own.
BLOCK, LONG = 1024, 8192


def in_blocks(df: DataFrame, table: DataFrame, on: str, work, columns: str) -> DataFrame:
    """The rows (key, tokens) of ``df`` looked up in a large ``table``, block by block.

    The distinct tokens of a block of neighbouring rows, far fewer than its tokens, meet the table; each block then
    gets its own entries, so there is never a shuffled row a token. ``work`` is given a block's rows and entries as
    Arrow tables and returns its columns: the key and ``columns``.
    """
    key, tokens = df.columns
    rows = numbered_rows(df)
    rows = rows.withColumn("_block", F.when(F.size(tokens) > LONG, F.col("_row")).otherwise(-1 - F.floor(F.col("_row") / BLOCK)))
    need = rows.select("_block", F.explode(tokens).alias(on)).distinct()
    entries = need.join(table, on).select(F.col("_block").alias("_of"), *table.columns)
    kind = df.schema[0].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(pa.RecordBatch.from_arrays([left[c].combine_chunks() for c in (key, tokens)], [key, tokens]), right)
        return pa.Table.from_batches([out])

    return rows.groupBy("_block").cogroup(entries.groupBy("_of")).applyInArrow(run, f"`{key}` {kind}, {columns}")


def mapping_arrays(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Symbols of a mapping (sym, values), how many tokens each has, where they start, and all of these tokens."""
    lists = table["values"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return table["sym"].combine_chunks(), size, np.cumsum(size) - size, lists.flatten()


def mapped(b: pa.RecordBatch, arrays: tuple, first: int, last: int, permissive: bool) -> pa.RecordBatch:
    """Rows of a key and tokens with each token replaced by its entry of :func:`mapping_arrays`."""
    syms, size, start, flat = arrays
    lists, own, n = token_lists(b.column(1))
    at = pc.index_in(own, value_set=syms)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + 1
    use = (place >= first) & (place <= last) & pc.is_valid(own).to_numpy(zero_copy_only=False)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    if not permissive and (use & ~known).any():
        raise ValueError(f"no entry for {own[int(np.flatnonzero(use & ~known)[0])]}")
    use &= known
    at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
    count = np.where(use, size[at] if len(size) else 0, 1)
    ends = np.cumsum(count)
    inner = np.arange(count.sum()) - np.repeat(ends - count, count)
    # both sources laid one after the other: entries of the table, then the tokens themselves
    take = np.where(np.repeat(use, count), np.repeat(start[at] if len(size) else at, count) + inner, len(flat) + np.repeat(np.arange(len(own)), count))
    values = pa.concat_arrays([flat, own]).take(pa.array(take))
    bound = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
    return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), values)], b.schema.names)


def mapped_in_place(df: DataFrame, table: pa.Table, first: int, last: int, permissive: bool) -> DataFrame:
    """The lists of the second column with each token replaced by its entry of ``table`` (sym, values)."""
    shared = df.sparkSession.sparkContext.broadcast(mapping_arrays(table))  # counted
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield mapped(b, shared.value, first, last, permissive)

    kind = next(f.dataType.simpleString() for f in df.schema if f.name == names[0])
    return df.mapInArrow(run, f"`{names[0]}` {kind}, `{names[1]}` array<string>")


def token_lists(lists: pa.ListArray) -> tuple[pa.ListArray, pa.Array, np.ndarray]:
    """Lists, their tokens laid end to end and the size of each list; a null list has none."""
    return lists, lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def symbols_to_ids(df: DataFrame, symtab: DataFrame, key: str, tokens: str, oov: int | None = None, in_place: int = SMALL) -> DataFrame:
    """Token ids by symbol table (sym, id); unknown tokens, null ones among them, become ``oov`` (counted in ``n_oov``), or are an error.

    A symbol listed twice counts once, and one with two ids is an error. Rows without tokens are left out; repeated
    keys are rows of their own. A table of at most ``in_place`` rows (counted) is looked up in place, without a shuffle;
    a larger one is joined, with the same results.
    """
    df = df.select(key, tokens).filter(F.size(tokens) > 0)
    symtab = one_each(symtab.select("sym", F.col("id").cast("int").alias("id")), "sym", "id")
    table = lookup(symtab, in_place)
    if table is not None:
        return numbered_in_place(df, table, oov)
    return in_blocks(df, symtab, "sym", lambda b, t: with_ids(b, t["sym"].combine_chunks(), t["id"].combine_chunks(), oov), "ids array<int>, n_oov long")


def write_ids(df: DataFrame, symtab: DataFrame, key: str, tokens: str, path: str, oov: int) -> dict[str, int]:
    """Write the ids of every row under ``path`` and return what was replaced: n_rows, n_tokens, n_oov, n_rows_oov.

    The counts are an observation of the rows on their way to the files: one pass, and no column of counts in the output.
    """
    seen = Observation("symbols")
    ids = symbols_to_ids(df, symtab, key, tokens, oov)
    watched = ids.observe(
        seen, F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_oov"), F.lit(0)).alias("n_oov"),
        F.count_if(F.col("n_oov") > 0).alias("n_rows_oov"),
    )
    watched.select(key, "ids").write.parquet(path)
    return seen.get


def with_ids(b: pa.RecordBatch, syms: pa.Array, ids: pa.Array, oov: int | None) -> pa.RecordBatch:
    """Rows of a key and tokens as the key, the tokens' ids and how many tokens have none."""
    _, own, n = token_lists(b.column(1))
    at = pc.index_in(own, value_set=syms)
    if oov is None and at.null_count:
        raise ValueError(f"unknown symbol {own.filter(pc.is_null(at))[0]}")
    missing = pc.is_null(at).to_numpy(zero_copy_only=False)
    bound = np.concatenate([[0], np.cumsum(n)])
    lacks = np.concatenate([[0], np.cumsum(missing)])[bound]
    value = pc.fill_null(ids.take(at), oov if oov is not None else 0)
    return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), value), pa.array(np.diff(lacks), pa.int64())], [b.schema.names[0], "ids", "n_oov"])


def numbered_in_place(df: DataFrame, table: pa.Table, oov: int | None) -> DataFrame:
    """The lists of the second column as ids of ``table`` (sym, id), and how many tokens of each it lacks."""
    shared = df.sparkSession.sparkContext.broadcast((table["sym"].combine_chunks(), table["id"].combine_chunks()))  # counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield with_ids(b, *shared.value, oov)

    return df.mapInArrow(run, f"`{df.columns[0]}` {df.schema[0].dataType.simpleString()}, ids array<int>, n_oov long")


def ids_to_symbols(df: DataFrame, symtab: DataFrame, key: str, ids: str, in_place: int = SMALL) -> DataFrame:
    """Inverse of :func:`symbols_to_ids`; an unknown or null id is an error, and so are two symbols of one id."""
    df = df.select(key, ids).filter(F.size(ids) > 0)
    symtab = one_each(symtab.select("sym", F.col("id").cast("int").alias("id")), "id", "sym").select("sym", "id")
    table = lookup(symtab, in_place)
    if table is not None:
        return named_in_place(df, table)
    return in_blocks(df, symtab, "id", lambda b, t: with_symbols(b, t["sym"].combine_chunks(), t["id"].combine_chunks()), "words array<string>")


def with_symbols(b: pa.RecordBatch, syms: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    """Rows of a key and ids as the key and the ids' symbols."""
    _, own, n = token_lists(b.column(1))
    at = pc.index_in(own.cast(pa.int32()), value_set=ids)
    if at.null_count:
        raise ValueError(f"unknown id {own.filter(pc.is_null(at))[0]}")
    bound = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bound), syms.take(at))], [b.schema.names[0], "words"])


def named_in_place(df: DataFrame, table: pa.Table) -> DataFrame:
    """The lists of the second column as symbols of ``table`` (sym, id)."""
    shared = df.sparkSession.sparkContext.broadcast((table["sym"].combine_chunks(), table["id"].combine_chunks()))  # counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield with_symbols(b, *shared.value)

    return df.mapInArrow(run, f"`{df.columns[0]}` {df.schema[0].dataType.simpleString()}, words array<string>")


def group_utterances(utt2spk: DataFrame, order: str) -> DataFrame:
    """Utterances of each speaker in input order, and the speaker's place by first appearance."""
    return utt2spk.groupBy("spk").agg(ordered_list([order], "utt").alias("utts"), F.min(order).alias("first"))


def flatten_utterances(spk2utt: DataFrame) -> DataFrame:
    """Inverse of :func:`group_utterances`; a speaker without utterances is an error."""
    checked = F.when(F.size("utts") > 0, F.col("utts")).otherwise(F.raise_error(F.concat(F.lit("no utterances for "), "spk")).cast("array<string>"))
    return spk2utt.select(F.explode(checked).alias("utt"), "spk")


def subset(df: DataFrame, n: int, order: str, mode: str = "first") -> DataFrame:
    """The first or last ``n`` rows, or ``n`` rows spread evenly by repeated halving.

    The spread gives each half of the rows half of the quota, down to single rows; every row finds its own fate by
    walking that halving, so nothing but its number and the total is needed.
    """
    if mode in ("first", "last"):
        return df.orderBy(F.col(order) if mode == "first" else F.desc(order)).limit(n)
    total = df.count()
    rows = numbered(df, [order], "_i").withColumn("_i", F.col("_i") - 1)
    start = F.struct(F.lit(0).alias("lo"), F.lit(total).alias("size"), F.lit(min(n, total)).alias("quota"))

    def halve(s: Column, _: Column) -> Column:
        half, quota = F.floor(s["size"] / 2).cast("int"), F.floor(s["quota"] / 2).cast("int")
        left = F.col("_i") < s["lo"] + half
        done = (s["size"] <= 1) | (s["quota"] == 0) | (s["quota"] == s["size"])
        return F.struct(
            F.when(done | left, s["lo"]).otherwise(s["lo"] + half).alias("lo"),
            F.when(done, s["size"]).when(left, half).otherwise(s["size"] - half).alias("size"),
            F.when(done, s["quota"]).when(left, quota).otherwise(s["quota"] - quota).alias("quota"),
        )

    kept = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve)
    return rows.filter(kept["quota"] > 0).drop("_i")


def shuffle(df: DataFrame, id_col: str, seed: int = 777) -> DataFrame:
    """A reproducible permutation: rows ordered by the MD5 of seed and id."""
    return df.orderBy(seeded(id_col, seed), id_col)


def replace_unknown(words: DataFrame, vocabulary: DataFrame, unk: str = "<UNK>") -> DataFrame:
    """Words (utt, pos, word) with those outside the vocabulary (word) replaced."""
    known = vocabulary.select("word").distinct().withColumn("_known", F.lit(True))
    return words.join(known, "word", "left").withColumn("word", F.when(F.col("_known"), F.col("word")).otherwise(unk)).drop("_known")


def drop_edges(edges: DataFrame, banned: DataFrame, cols: tuple[str, str]) -> DataFrame:
    """Rows in which neither of two columns holds a banned symbol (column sym)."""
    for c in cols:
        edges = edges.join(banned.select(F.col("sym").alias(c)), c, "left_anti")
    return edges


def derive_speaker(col: str, rule: str = "underscore") -> Column:
    """Speaker from an id: the part before the first ``_``, or the first three characters."""
    return F.split(col, "_")[0] if rule == "underscore" else F.substring(col, 1, 3)


def rename_ids(df: DataFrame, cols: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """The same prefix and suffix on every id column; no join is needed."""
    for c in cols:
        df = df.withColumn(c, F.concat(F.lit(prefix), c, F.lit(suffix)))
    return df


def normalize_words(words: Column, noise: str = "<NOISE>") -> Column:
    """Upper-case transcript words without markup; bracketed sounds become the noise word."""

    def fix(w: Column) -> Column:
        w = F.regexp_replace(F.upper(w), r"\\", "")
        w = F.regexp_replace(F.regexp_replace(w, r"^%PERCENT$", "PERCENT"), r"^\.POINT$", "POINT")
        w = F.regexp_replace(F.regexp_replace(w, "--DASH$", "-DASH"), r"^<(.+)>$", "$1")
        gone = w.rlike(r"^(\[<.*\]|\[.*>\]|\[.*/\]|\[/.*\]|~|\.)$")
        return F.when(gone, None).when(w.rlike(r"^\[.*\]$"), noise).otherwise(w)

    return F.filter(F.transform(words, fix), lambda w: w.isNotNull() & (w != ""))


def substitute(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression substitutions, as a caller's scoring filter."""
    for pattern, to in rules:
        col = F.regexp_replace(col, pattern, to)
    return col


def plain_lexicon(lexicon: DataFrame) -> DataFrame:
    """Entries whose word has no ``;`` or ``,``; a phone with either is an error."""
    bad = F.exists("phones", lambda p: p.rlike("[;,]"))
    return lexicon.filter(~F.col("word").rlike("[;,]")).withColumn("phones", F.when(bad, F.raise_error(F.concat(F.lit("bad phone in "), "word")).cast("array<string>")).otherwise(F.col("phones")))


def reverse_lexicon(lexicon: DataFrame) -> DataFrame:
    """Letters and phones in reverse order."""
    return lexicon.select(F.reverse("word").alias("word"), F.reverse("phones").alias("phones"))


def load_dictionary(lines: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Pronouncing-dictionary lines: comments go, ``WORD(2)`` becomes ``WORD``, entries are distinct, fixed ones are added."""
    d = lines.filter(~F.col("line").startswith(";;;")).select(F.regexp_replace("line", r"^(\S+?)\(\d+\)", "$1").alias("line"))
    if extra:
        d = d.unionByName(lines.sparkSession.createDataFrame([(x,) for x in extra], "line string"))
    parts = F.split(F.trim("line"), r"\s+")
    return d.distinct().select(parts[0].alias("word"), F.slice(parts, 2, F.size(parts)).alias("phones"))


def split_sentences(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A token ending in a period that is no word of the list loses the period and ends its line."""
    known = vocabulary.select("word").distinct().withColumn("_known", F.lit(True))
    w = words.join(known, "word", "left")
    ends = F.col("word").endswith(".") & F.col("_known").isNull()
    w = w.withColumn("_ends", ends.cast("int")).withColumn("word", F.when(ends, F.expr("substring(word, 1, length(word) - 1)")).otherwise(F.col("word")))
    before = Window.partitionBy("utt").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("line", F.coalesce(F.sum("_ends").over(before), F.lit(0)))
    return w.filter("word <> ''").groupBy("utt", "line").agg(F.array_join(ordered_list(["pos"], "word"), " ").alias("text"))


def syllable_phones(df: DataFrame, col: str, initials: dict[str, str], finals: dict[str, list[str]]) -> DataFrame:
    """Romanised syllables with a tone digit into phones: the initial's phone, then the final's with the tone on each."""
    start = F.regexp_extract(col, r"^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw]?)", 1)
    final = F.regexp_extract(col, r"^(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw]?)([a-z]+)", 1)
    tone = F.regexp_extract(col, r"(\d)$", 1)
    first = F.create_map(*[F.lit(x) for kv in initials.items() for x in kv])
    rest = F.create_map(*[x for k, v in finals.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    head = F.when(start == "", F.array().cast("array<string>")).otherwise(F.array(first[start]))
    return df.withColumn("phones", F.concat(head, F.transform(rest[final], lambda p: F.concat(p, tone))))


def job_status(jobs: DataFrame, status: str, user: str | None = None) -> DataFrame:
    """Jobs in a state, optionally of one user: plain pushed-down equality."""
    return jobs.filter((F.col("status") == status) & (F.lit(True) if user is None else F.col("username") == user))
