"""URL rules with redirect equivalence: block decisions spread to aliases, explicit rules come first."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, join_checked, sliced, store, table
from .components import connected_components

#: verdict, host, path: the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for a text without ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring_index(F.concat(u, F.lit("")), "://", 1))
    at = F.length(rest) + 4
    tail = F.when(rest.isNull(), F.lit("")).otherwise(F.substring(u, at, F.length(u)))
    host = F.regexp_extract(tail, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(tail, F.length(host) + 1, F.length(tail)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(spark: SparkSession, pages: DataFrame, rules: DataFrame | list) -> DataFrame:
    """Add ``rule`` and ``rule_verdict``: the longest rule that fits host and path, or null.

    A host has few suffixes, so each distinct host is exploded into them and meets the rules in an equi-join;
    the host's candidate rules then go back to its rows, as a stored table, so that a hot host can be split.
    Rules of equal length cannot fit one URL unless they are the same text; allow wins then.
    """
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    rules = store(rules.select(F.col("verdict").alias("rv"), F.col("host").alias("rh"), F.col("path").alias("rp")), "rules")
    hosts = pages.select("host").distinct()
    label = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.concat_ws(".", F.slice(label, i, F.size(label))))
    small = rules.count() <= BROADCAST_ROWS
    fits = hosts.select("host", F.explode(suffixes).alias("rh")).join(F.broadcast(rules) if small else rules, "rh")
    fits = store(fits.groupBy("host").agg(F.collect_list(F.struct("rh", "rp", "rv")).alias("fits")), "fits")
    best = F.array_max(
        F.transform(
            F.filter("fits", lambda r: F.col("path").startswith(r["rp"])),
            lambda r: F.struct((F.length(r["rh"]) + F.length(r["rp"])).alias("len"), (r["rv"] == "allow").alias("allow"), F.concat(r["rh"], r["rp"]).alias("rule"), r["rv"].alias("verdict")),
        )
    )
    return join_checked(pages, fits, "host", "left").withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.verdict")).drop("_best", "fits")


TAG = re.compile(r"""<(link|meta)\b((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.I)
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
REFRESH = re.compile(r"""^[\s\d.]*[;,]?\s*(?:url\s*=\s*)?["']?([^"']*)""", re.I)


def link_targets(url: str, page: str) -> list[str]:
    """Targets of a page's canonical links and refresh redirects, resolved against its URL.

    Character references are decoded; relative targets and those that begin with ``//`` or ``/`` are resolved. A
    target that cannot be resolved is left out.
    """
    out = []
    for kind, inside in TAG.findall(page):
        own = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").strip() for m in ATTRIBUTE.finditer(inside)}
        target = ""
        if kind.lower() == "link" and "canonical" in own.get("rel", "").lower().split():
            target = own.get("href", "")
        elif kind.lower() == "meta" and own.get("http-equiv", "").lower() == "refresh":
            target = REFRESH.match(own.get("content", ""))[1].strip()
        if target:
            try:
                out.append(urljoin(url, target))
            except ValueError:  # not a URL
                continue
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """Rows (url, to_url) of all canonical links and refresh redirects; only pages that may have one are parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            pairs = [(u, t) for u, h in zip(*(c.to_pylist() for c in b.columns)) for t in link_targets(u, h)]
            yield pa.RecordBatch.from_pydict({"url": pa.array([u for u, _ in pairs], pa.string()), "to_url": pa.array([t for _, t in pairs], pa.string())})

    may = pages.select("url", "html").filter("url is not null").filter(F.col("html").rlike(r"(?i)canonical|refresh"))
    return may.mapInArrow(run, "url string, to_url string")


def url_verdicts(
    pages: DataFrame, rules: DataFrame | list = RULES, redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Judge every page's URL.

    Nodes are URLs reduced to lower-cased host and path (scheme, query and fragment do not make another page).
    Edges join a page to the targets of its canonical links and refresh redirects, and the rows of ``redirects``
    (from_url, to_url) if given. Each connected component is one resource under several names. A URL with a
    matching rule keeps that rule's verdict. A URL without one is blocked if some alias matches a block rule
    and none matches an allow rule: an explicit allow outranks a block that arrives through an alias. All
    others are allowed. Both ends of an edge are judged, whether or not they are pages of the table.

    A null URL or one without ``://`` has an empty host and path, no rule and no aliases, and is allowed; a null
    page has no links; a very long page is searched whole. Repeated rows, rows of one id and rows without one
    each get a row; an empty table gives an empty result. Only the named columns are read, so other columns may
    have any name.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    key = F.when(F.col("host") != "", F.concat("host", "path"))
    judged = matching_rule(spark, base.select("page_id", host.alias("host"), path.alias("path")), rules).withColumn("node", key)

    links = page_links(base)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").alias("url"), "to_url"))
    to_host, to_path = url_parts(F.col("to_url"))
    edges = links.select(host.alias("host"), path.alias("path"), to_host.alias("to_host"), to_path.alias("to_path"))
    edges = edges.withColumns({"a": F.concat("host", "path"), "b": F.concat("to_host", "to_path")})
    edges = store(edges.filter("a <> b and host <> '' and to_host <> ''").distinct(), "links")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.col("node").alias("alias_group"))

    groups = store(connected_components(edges.select("a", "b")), "groups")
    ends = edges.select("host", "path").unionByName(edges.select(F.col("to_host").alias("host"), F.col("to_path").alias("path"))).distinct()
    signs = matching_rule(spark, ends, rules).filter("rule_verdict is not null").select(F.concat("host", "path").alias("node"), "rule_verdict")
    signs = groups.join(signs.hint("merge"), "node")
    spread = signs.groupBy("component").agg(F.max(F.col("rule_verdict") == "block").alias("any_block"), F.max(F.col("rule_verdict") == "allow").alias("any_allow"))
    marks = groups.join(store(spread, "spread").hint("merge"), "component", "left").select("node", "component", (F.col("any_block") & ~F.col("any_allow")).alias("alias_block"))
    out = join_checked(judged, store(marks, "marks"), "node", "left")
    verdict = F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict")).when(F.col("alias_block"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "node").alias("alias_group"))


def op5_url_filter(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages")).drop("alias_group")


ORACLE = r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, instr(coalesce(url, ''), '://') AS i FROM pages),
x AS (SELECT page_id, html, url, CASE WHEN i = 0 THEN '' ELSE substr(url, i + 3) END AS tail FROM u),
y AS (SELECT page_id, html, url, tail, regexp_extract(tail, '^[^/?#]*') AS h FROM x),
z AS (SELECT page_id, html, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(tail, length(h) + 1), '^[^?#]*') AS path FROM y),
r(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
lk AS (SELECT host || path AS a, url, unnest(list_concat(
    regexp_extract_all(html, '(?is)<link\b[^>]*rel="canonical"[^>]*href="([^"]+)"', 1),
    regexp_extract_all(html, '(?is)<meta\b[^>]*http-equiv="refresh"[^>]*url=([^">]+)"', 1))) AS t FROM z),
la AS (SELECT a, CASE WHEN instr(t, '://') > 0 THEN t WHEN t LIKE '/%' THEN regexp_extract(url, '^[^/?#]*://[^/?#]*') || t END AS t FROM lk),
lb AS (SELECT a, translate(regexp_extract(substr(t, instr(t, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(substr(t, instr(t, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS b FROM la WHERE t IS NOT NULL),
e AS (SELECT a, b FROM lb WHERE a <> b UNION SELECT b, a FROM lb WHERE a <> b),
cc AS (SELECT a AS n, a AS m FROM e UNION SELECT cc.n, e.b FROM cc JOIN e ON cc.m = e.a),
names AS (SELECT host, path, host || path AS n FROM z UNION SELECT regexp_extract(m, '^[^/]*'), regexp_extract(m, '^[^/]*(.*)$', 1), m FROM cc),
f AS (SELECT n, v, r.h || r.p AS rule, row_number() OVER (PARTITION BY n ORDER BY length(r.h || r.p) DESC) AS k FROM names
    JOIN r ON (host = r.h OR host LIKE '%.' || r.h) AND path LIKE r.p || '%'),
b AS (SELECT n, v, rule FROM f WHERE k = 1),
al AS (SELECT cc.n, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS blocked FROM cc JOIN b ON b.n = cc.m GROUP BY cc.n)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM z LEFT JOIN b ON b.n = host || path LEFT JOIN al ON al.n = host || path
"""
