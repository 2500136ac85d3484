"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import fresh, join_checked, map_texts, sliced, store, table

SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: How far a host's failure rates may move a rule's limit, either way.
LEEWAY = 1.25


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The six counts of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = {w for w, c in Counter(windows).items() if c > 1}
        last = 0  # the first position not yet counted
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return n, len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def count_columns(texts: list[str | None]) -> list[list[int]]:
    """The six counts of some texts, as columns."""
    return [list(c) for c in zip(*map(text_counts, texts))]


def document_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row of counts for each document, in one narrow pass."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return map_texts(cols, lambda: count_columns, f"doc_id long, host string, {COUNTS}", 2)


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    words = F.col(f"{prefix}n_words")
    return (words < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * words)


HOST_RULES = ("symbols", "lines", "lengths")


def fails(prefix: str = "", factor: Callable[[str], Column] = lambda rule: F.lit(1.0)) -> dict[str, Column]:
    """Host rules, each true where the document fails it at its limit times ``factor`` of the rule.

    symbols: more than one symbol per two words; lines: more than half of the lines repeat an earlier one; lengths:
    words of more than 15 or fewer than 2.5 characters on average, the latter limit divided by the factor.
    """

    def c(name: str) -> Column:
        return F.col(prefix + name)

    return {
        "symbols": c("n_symbols") > 0.5 * factor("symbols") * c("n_words"),
        "lines": c("n_dup_lines") > 0.5 * factor("lines") * c("n_lines"),
        "lengths": (c("word_chars") > 15.0 * factor("lengths") * c("n_words")) | (c("word_chars") * factor("lengths") < 2.5 * c("n_words")),
    }


def dropped(prefix: str = "") -> Column:
    """Whether a document goes, given its counts and its host's factors (columns ``factor_`` and the rule)."""
    out = base_failed(prefix)
    for rule in fails(prefix, lambda k: F.col(f"{prefix}factor_{k}")).values():
        out = out | rule
    return out


def host_verdicts(counts: DataFrame, leeway: float) -> DataFrame:
    """Verdict on every host: host, host_docs and, for each rule, its shrunk failure rate and the factor of its limits.

    For each rule the beta prior is fitted to the hosts' rates by moments: with mean m and variance v, its
    weight is s = m (1 - m) / v - 1, held between 1 and 1000, and a host with f failures in n documents gets
    (f + s m) / (n + s). The host's limits are multiplied by the square root of m over that rate, held between
    1 / ``leeway`` and ``leeway``: hosts that fail a rule more than others are held to it more strictly, hosts that keep to
    it get the benefit of the doubt. The fit is an aggregate over hosts, so it costs one row per rule.
    """
    rules = fails()
    hosts = store(counts.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(r.cast("long")).alias(k) for k, r in rules.items()]), "hosts")
    rate = {k: F.col(k) / F.col("n") for k in rules}
    fit = hosts.agg(*[F.avg(rate[k]).alias(f"m_{k}") for k in rules], *[F.var_pop(rate[k]).alias(f"v_{k}") for k in rules]).first()
    out = [F.col("host"), F.col("n").alias("host_docs")]
    for k in rules:
        m, v = fit[f"m_{k}"] or 0.0, fit[f"v_{k}"] or 0.0
        s = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        shrunk = (F.col(k) + F.lit(s * m)) / (F.col("n") + F.lit(s))
        factor = F.least(F.lit(leeway), F.greatest(F.lit(1 / leeway), F.sqrt(F.lit(m) / shrunk))) if m > 0 else F.lit(1.0)
        out += [shrunk.alias(f"rate_{k}"), factor.alias(f"factor_{k}")]
    return store(hosts.select(*out), "verdicts")


def host_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", leeway: float = LEEWAY) -> DataFrame:
    """Quality verdict of every document.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows. A document
    that passes these is dropped (``kept`` false) when it fails a host rule (:func:`fails`) at its host's own limit,
    which follows from the host's shrunk failure rate (:func:`host_verdicts`).

    Null texts count as empty (and fail as short); a null host is a host of its own; repeated rows each get a
    row, as do rows of one id or without one; a very long text is counted whole; an empty table gives an empty
    result. Only the named columns are read, so other columns may have any name.
    """
    counts = store(document_counts(docs, id_col=id_col, text_col=text_col, host_col=host_col), "counts")
    verdicts = host_verdicts(counts, leeway).withColumnRenamed("host", "of")
    joined = join_checked(counts, verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~dropped()).alias("kept"), "host")


def drop_low_quality(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", leeway: float = LEEWAY) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, that :func:`host_quality` keeps.

    Rows are counted once and stored with their counts, from which both the hosts' rates and the verdicts are
    read; no text is shuffled. Nulls, long texts, repeated rows and empty tables are treated as there; columns of
    any name pass through.
    """
    tag = fresh([c[:3] for c in docs.columns], "_q_")
    names = [f"{tag}{x.split()[0]}" for x in COUNTS.split(", ")]
    out, at = StructType(list(docs.schema)), docs.columns.index(text_col)
    for n in names:
        out = out.add(n, "long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            counts = [pa.array(c, pa.int64()) for c in count_columns(b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *counts], [*b.schema.names, *names])

    counted = store(docs.mapInArrow(add, out), "counted")
    host = F.col(f"`{host_col}`").cast("string")
    plain = counted.select(host.alias("host"), *[F.col(n).alias(n[len(tag) :]) for n in names])
    verdicts = host_verdicts(plain, leeway)
    verdicts = verdicts.select(*[F.col(c).alias(tag + c) for c in verdicts.columns])
    joined = join_checked(counted, verdicts, host.eqNullSafe(F.col(f"{tag}host")), "left")
    return joined.filter(~dropped(tag)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_host_quality(spark, sf_dir):
    return host_quality(table(spark, sf_dir, "documents")).drop("host")


ORACLE = """
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, w FROM d),
g AS (SELECT doc_id, unnest(range(1, n_words - 1)) AS i, w FROM k WHERE n_words >= 3),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM g),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM t),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM m WHERE c > 1) GROUP BY doc_id),
c AS (SELECT k.doc_id, host, n_words, word_chars, n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words FROM k LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 2 * n_symbols > n_words AS f3, 2 * n_dup_lines > n_lines AS f4,
    word_chars > 15 * n_words OR 2 * word_chars < 5 * n_words AS f5 FROM c),
h AS (SELECT host, count(*) AS n, unnest([1, 2, 3]) AS rule, unnest([sum(f3::INT), sum(f4::INT), sum(f5::INT)]) AS x FROM f GROUP BY host),
b AS (SELECT rule, avg(x / n) AS m, var_pop(x / n) AS v FROM h GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM b),
r AS (SELECT host, list(CASE WHEN m > 0 THEN least(1.25::DOUBLE, greatest(1 / 1.25::DOUBLE, sqrt(m / ((x + s * m) / (n + s))))) ELSE 1.0::DOUBLE END ORDER BY rule) AS k FROM h JOIN s USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
    NOT (f1 OR f2 OR n_symbols > 0.5::DOUBLE * k[1] * n_words OR n_dup_lines > 0.5::DOUBLE * k[2] * n_lines
        OR word_chars > 15::DOUBLE * k[3] * n_words OR word_chars * k[3] < 2.5::DOUBLE * n_words) AS kept
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""
