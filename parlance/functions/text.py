"""Text, number and HTML functions, and jobs over distinct values of a corpus."""

from __future__ import annotations

import html as html_lib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

c = F.col


def nfkc(col: Column) -> Column:
    """Unicode normal form KC, in Arrow batches: Spark has no built-in for it."""

    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else None)

    return F.pandas_udf(normal, "string")(col)


def standardise(col: Column) -> Column:
    """NFKC, white space as single spaces, no control or format characters, plain quotes and dashes."""
    x = F.regexp_replace(nfkc(col), r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ")
    return F.trim(F.translate(F.regexp_replace(x, r"[\p{Cc}\p{Cf}]", ""), "\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--"))


def strip_timing(col: Column) -> Column:
    """Remove the opening and closing time and confidence tags."""
    return F.regexp_replace(col, r"</?(?:time|conf)\b[^>]*>", "")


TOKEN = re.compile(r"<[^>]*>|&(?:#\d+|#x[0-9a-fA-F]+|\w+);|.", re.S)


def html_with_map(page: str) -> tuple[str, list[tuple[int, int]]]:
    """Plain text of a page, and for each of its characters (place in the page, place in the text).

    Tags go, with the content of time marks; line and paragraph breaks become spaces; a character reference is one
    character, white space if its character is, nothing if it is a control.
    """
    out, places, hidden = [], [], False
    for m in TOKEN.finditer(page):
        x = m[0]
        if x[0] == "<" and len(x) > 1:
            name = re.match(r"</?\s*(\w*)", x)[1].lower()
            if name == "time":
                hidden = not x.startswith("</")
            x = " " if name in ("br", "p", "div", "li", "h1") else ""
        elif x[0] == "&" and len(x) > 1:
            x = html_lib.unescape(x)
        if hidden and x != " ":
            continue
        for ch in x:
            kind = unicodedata.category(ch)
            if kind == "Cc" and not ch.isspace():
                continue
            places.append((m.start(), len(out)))
            out.append(" " if ch.isspace() else ch)
    return "".join(out), places


RUN = re.compile(r"<[^>]*>|&(?:#\d+|#x[0-9a-fA-F]+|\w+);|[^<&]+|.", re.S)
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]")
BLANK = re.compile(r"\s")


def html_plain(page: str) -> str:
    """The text of :func:`html_with_map` without its map: run by run instead of character by character."""
    out, hidden = [], False
    for m in RUN.finditer(page):
        x = m[0]
        if x[0] == "<" and len(x) > 1:
            name = re.match(r"</?\s*(\w*)", x)[1].lower()
            if name == "time":
                hidden = not x.startswith("</")
            if name in ("br", "p", "div", "li", "h1"):
                out.append(" ")
            continue
        if x[0] == "&" and len(x) > 1:
            x = html_lib.unescape(x)
            if hidden and x != " ":
                continue
        elif hidden:
            x = " " * x.count(" ")
        out.append(CONTROL.sub("", BLANK.sub(" ", x)))
    return "".join(out)


def html_to_text(pages: DataFrame, id_col: str, html_col: str, with_map: bool = False, most: int = 1 << 20) -> DataFrame:
    """Plain text of every page and, with ``with_map``, the map of its characters.

    Maps are numbers in Arrow from page to page, and a batch of them ends with the page that brings it to ``most`` characters.
    """

    place = pa.struct([("page", pa.int32()), ("text", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [h or "" for h in b.column(1).to_pylist()]
            if not with_map:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_plain(h) for h in html], pa.string())], ["id", "text"])
                continue
            done, size, texts, at, flat = 0, 0, [], [0], ([], [])

            def packed() -> pa.RecordBatch:
                maps = pa.StructArray.from_arrays([pa.concat_arrays(x) for x in flat], fields=list(place))
                return pa.RecordBatch.from_arrays([b.column(0)[done : done + len(texts)], pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), maps)], ["id", "text", "places"])

            for h in html:
                one, places = html_with_map(h)
                both = np.array(places, np.int32).reshape(-1, 2)
                texts.append(one)
                at.append(at[-1] + len(both))
                for x, side in zip(flat, both.T):
                    x.append(pa.array(side))
                size += len(both)
                if size >= most:
                    yield packed()
                    done, size, texts, at, flat = done + len(texts), 0, [], [0], ([], [])
            if texts:
                yield packed()

    schema = "id long, text string" + (", places array<struct<page:int,text:int>>" if with_map else "")
    return pages.select(c(id_col).cast("long").alias("id"), c(html_col).alias("html")).mapInArrow(run, schema)


def insert_tags(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """Pages (id, html) with tags (id, at, tag) put in at character places; several at one place keep their order by tag."""
    t = tags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("tags"))
    cut = F.aggregate(
        "tags", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring("html", s["at"] + 1, x["at"] - s["at"]), x["tag"]).alias("out"), x["at"].cast("int").alias("at")),
        lambda s: F.concat(s["out"], F.substring("html", s["at"] + 1, F.length("html"))),
    )
    return pages.join(t, "id", "left").withColumn("html", F.when(c("tags").isNotNull(), cut).otherwise(c("html"))).drop("tags")


# fixed values: English number words
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
UNITS = ["", "thousand", "million", "billion", "trillion", "quadrillion"]
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
# fixed values: Afrikaans number words
AF_ONES = "nul een twee drie vier vyf ses sewe agt nege tien elf twaalf dertien veertien vyftien sestien sewentien agtien negentien".split()
AF_TENS = "twintig dertig veertig vyftig sestig sewentig tagtig negentig".split()
AF_UNITS = ["", "duisend", "miljoen", "miljard", "biljoen", "biljard"]
AF_ORDINALS = {"een": "eerste", "drie": "derde", "nege": "negende", "sewe": "sewende"}
AF_DE = ("twee", "vier", "vyf", "ses", "elf", "twaalf")


def _groups(n: int) -> list[int]:
    """Groups of three digits, the lowest first."""
    out = []
    while n:
        n, r = divmod(n, 1000)
        out.append(r)
    return out


def english(n: int, form: str = "cardinal", comma: str = " ", hyphen: str = " ") -> str:
    """English words of a number.

    ``cardinal`` has no ``and``; ``ordinal`` makes the last word an ordinal; ``expand`` says ``and`` after
    ``hundred``, and between a larger unit and a last part under one hundred that ends in a word from one to
    nineteen. ``comma`` stands between the units, ``hyphen`` between tens and ones.
    """
    if n < 0:
        return "negative " + english(-n, form, comma, hyphen)

    def small(k: int) -> str:
        if k >= 100:
            link = " hundred and " if form == "expand" else " hundred "
            return ONES[k // 100] + (link + small(k % 100) if k % 100 else " hundred")
        return ONES[k] if k < 20 else TENS[k // 10 - 2] + (hyphen + ONES[k % 10] if k % 10 else "")

    parts = [f"{small(g)} {UNITS[i]}".rstrip() for i, g in reversed(list(enumerate(_groups(n)))) if g]
    tail = n % 1000
    link = " and " if form == "expand" and (0 < tail < 20 or tail < 100 and tail % 10) else comma
    text = comma.join(parts[:-1]) + (link if len(parts) > 1 else "") + parts[-1] if parts else ONES[0]
    if form == "ordinal":
        head, last = re.fullmatch(r"(.*?)([a-z]+)", text).groups()
        text = head + (ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))
    return text


def afrikaans(n: int, form: str = "cardinal") -> str:
    """Afrikaans words of a number; ``en`` joins a last word from one to nineteen to a larger unit before it."""
    if n < 0:
        return "minus " + afrikaans(-n, form)

    def small(k: int) -> str:
        if k >= 100:
            rest = k % 100
            return AF_ONES[k // 100] + " honderd" + ((" en " if rest < 20 else " ") + small(rest) if rest else "")
        if k < 20:
            return AF_ONES[k]
        return (AF_ONES[k % 10] + " en " if k % 10 else "") + AF_TENS[k // 10 - 2]

    parts = [f"{small(g)} {AF_UNITS[i]}".rstrip() for i, g in reversed(list(enumerate(_groups(n)))) if g]
    text = " ".join(parts[:-1] + (["en"] if len(parts) > 1 and 0 < n % 1000 < 20 else []) + parts[-1:]) or AF_ONES[0]
    if form == "ordinal":
        head, sep, last = text.rpartition(" ")
        text = head + sep + (AF_ORDINALS.get(last) or last + ("de" if last in AF_DE or last.endswith("tien") else "ste"))
    return text


def verbalise(words: DataFrame, lang: str = "en", form: str = "cardinal") -> DataFrame:
    """Words (utt, pos, word) with each whole number in words: only the distinct numbers are expanded, then joined back."""
    f = english if lang == "en" else afrikaans

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(spoken=[f(int(n), form) for n in b["word"]])

    numbers = words.filter(c("word").rlike(r"^-?\d{1,17}$")).select("word").distinct()
    spoken = numbers.mapInPandas(expand, "word string, spoken string")
    return words.join(spoken, "word", "left").withColumn("word", F.coalesce("spoken", "word")).drop("spoken")


def enumerate_phrase(items: Column) -> Column:
    """A list recited: ``a, b and c``."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(F.concat(head, F.lit(" and "), F.try_element_at(items, n)))


def token_spans(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """All matches of typed patterns: id, kind, start, end, token; those of a text in the order of start and end. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: re.compile(p) for k, p in patterns.items()}
        for b in batches:
            row, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = sorted(((k, m.start(), m.end(), m[0]) for k, p in compiled.items() for m in p.finditer(t or "") if m[0]), key=lambda x: x[1:3])
                row += [i] * len(own)
                found += own
            kind, start, end, token = zip(*found) if found else ((),) * 4
            columns = [pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(token, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *columns], ["id", "kind", "start", "end", "token"])

    return docs.select(c(id_col).cast("long").alias("id"), c(text_col).alias("text")).mapInArrow(run, "id long, kind string, start long, end long, token string")


def long_form(short: str, before: str) -> str | None:
    """The words before ``(short)`` that spell it: its letters are found right to left, the first at a word's start."""
    words = before.split()
    most = min(len(short) + 5, 2 * len(short))
    text = " ".join(words[-most:])
    i = len(text) - 1
    for k in range(len(short) - 1, -1, -1):
        ch = short[k].lower()
        if not ch.isalnum():
            continue
        while i >= 0 and (text[i].lower() != ch or (k == 0 and i > 0 and text[i - 1].isalnum())):
            i -= 1
        if i < 0:
            return None
        i -= 1
    found = text[i + 1 :].strip()
    return found if len(found) > len(short) else None


def abbreviations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of long and short form, ``long form (SF)``: id, short, long."""
    shape, most = re.compile(r"\(([A-Za-z][A-Za-z0-9.-]{1,9})\)"), 200

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, short, long = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for m in shape.finditer(t or ""):
                    # what stands before it: back to a bracket, at least 2 and at most 200 characters
                    end = m.start()
                    low = max(0, end - most)
                    low = max(low, t.rfind("(", low, end) + 1, t.rfind(")", low, end) + 1)
                    if end - low >= 2 and (found := long_form(m[1], t[low:end])) is not None:
                        row.append(i)
                        short.append(m[1])
                        long.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(short, pa.string()), pa.array(long, pa.string())], ["id", "short", "long"])

    return docs.select(c(id_col).cast("long").alias("id"), c(text_col).alias("text")).mapInArrow(run, "id long, short string, long string")


def seconds_to_hms(col: Column) -> Column:
    s = F.floor(col)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def centisecond_id(name: Column, start: Column, end: Column) -> Column:
    cs = lambda x: F.lpad(F.floor(F.round(x * 100, 3)).cast("string"), 6, "0")
    return F.concat_ws("_", name, cs(start), cs(end))


def parse_hms(col: Column) -> Column:
    p = F.split(col, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def grid_state(out: Column) -> Column:
    """State of a job from its queue listing or accounting record: the queue's letter, D or F; an empty output is an error."""
    letter = F.regexp_extract(out, r"(?m)^\s*state:\s*(\w+)", 1)
    failed, code = F.regexp_extract(out, r"(?m)^failed\s+(\d+)", 1), F.regexp_extract(out, r"(?m)^exit_status\s+(\d+)", 1)
    return F.when(letter != "", letter).when(failed == "", "error").when((failed == "0") & (code == "0"), "D").otherwise("F")
