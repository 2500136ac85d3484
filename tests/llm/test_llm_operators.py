"""Training-data operators on small fixtures: brute force, round trips, nulls, empty tables, ties, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer
from pyspark.sql import functions as F

pytest.importorskip("parlance.llm")
from parlance.llm import chat, components, decontaminate, html_text, lm, packing, quality, simhash, token_files, tokens, toxicity, url_filter  # noqa: E402
from parlance.llm.common import new_path, store  # noqa: E402

DOCS = "doc_id long, text string, source string, fp string, n int, w string"


def frame(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, source, "x", 1, "y") for i, t in enumerate(texts)], DOCS)


PROSE = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
TEXTS = [PROSE, PROSE, PROSE + " end", None, "", "   ", "a", "a b c", "Öl und Bö\nzwei  Leer", "x" * 5000, "the quick brown fox jumps over the lazy dog " * 60]


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=lambda r: tuple((x is None, x) for x in r))


# --- 1 decontamination

def brute_contained(docs, items, width=5, share=0.8):
    def shingles(t):
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    out = []
    for d, t in docs:
        for i, b in items:
            s = shingles(b)
            k = len(s & shingles(t))
            if s and k >= int(np.ceil(share * len(s) - 1e-9)):
                out.append((d, i, len(s), k))
    return sorted(out)


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([3, 5, 8, 20, 40, 41, 80, 0])] + [(8, None)]
    docs = []
    for d in range(60):
        w = list(rng.choice(vocab, 120))
        b = items[d % 7][1].split()
        for _ in range(d % 5):
            b[int(rng.integers(len(b)))] = "changed"
        w[30:30] = [x.upper() if d % 2 else x for x in b]
        docs.append((d, " ".join(w)))
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1])]
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "n_item", "n_shared") == sorted(set(brute_contained(docs, items)))


def test_decontamination_plan_is_native_and_empty_tables(spark):
    items = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    got = decontaminate.contained_items(frame(spark, TEXTS), items)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert {r[0] for r in rows(got, "doc_id")} == {0, 1, 2}
    assert decontaminate.contained_items(frame(spark, []), items).count() == 0
    assert decontaminate.contained_items(frame(spark, TEXTS), items.limit(0)).count() == 0


# --- 2 token files

@pytest.mark.parametrize("bits", [1, 3, 7, 12, 15, 16, 17, 20])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 4099).astype(np.uint32)
    assert np.array_equal(token_files.unpack_bits(token_files.pack_bits(ids, bits), bits, len(ids)), ids)


def test_token_files_round_trip(spark):
    docs = frame(spark, TEXTS).unionByName(spark.createDataFrame([(None, "no id", "a", "x", 1, "y")], DOCS)).repartition(3)
    manifest = store(token_files.write_token_files(docs, new_path(spark, "t"), files=3), "m")
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    tok = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    want = [(None, "no id"), *enumerate(TEXTS)]
    start = 0
    for r, (d, t) in zip(got, want):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, start, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert len(got) == len(want)


def test_token_files_of_no_documents(spark):
    manifest = token_files.write_token_files(frame(spark, []), new_path(spark, "t"))
    assert token_files.read_token_files(manifest).count() == 0


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, keep, plain):
    path = tokens.public_path(name)
    odd = [
        "a  b\n\nc ", " lead", "tail ", "don't he's IT'S we'll.x", "\u0130stanbul \u03a3\u0391\u03a3 \ufb01", "tab\there", "a\u00a0b", "x\0y", "<|endoftext|> a", "a<|endoftext|>b <|STARTOFTEXT|>",
        "1234 5,6 7.8$ ###*** a%%%b", "\u00e9\u0301 combining.\u0338 a*\u0301", "\u00c9t\u00e9.\n\u00c0", "", "\nx", "x\n", "Word... &amp;|*#$%!?;:,", "\u4e2d\u6587\uff0c\u5b57 \U0001f600", None, "x" * 3000,
    ]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    enc = tokens.Encoder(path, keep, plain)
    for _ in range(2):  # new pieces, then known ones
        for t, got in zip(odd, enc.encode_many(odd)):
            assert got.tolist() == (library.encode(t, add_special_tokens=False).ids if t else []), t


def test_encoder_memo_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    path = tokens.public_path("byte_bpe_50k.json")
    enc, library = tokens.Encoder(path, True), Tokenizer.from_file(path)
    for k in range(20):
        text = " ".join(f"w{i}x" for i in range(17 * k, 17 * k + 40))
        assert enc.encode_many([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(enc.young) < 200


#: Beside a null, such an id does not survive a detour through floating point.
BIG = 9007199254740993


def with_big_ids(spark, texts):
    rows = [(None if i % 3 == 2 else BIG + 2 * i, t, "a", "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).coalesce(1), sorted((r[0] for r in rows), key=lambda x: (x is None, x or 0))


def test_large_ids_beside_nulls_stay_exact(spark):
    df, ids = with_big_ids(spark, TEXTS)
    every = lambda out: sorted((r[0] for r in out.collect()), key=lambda x: (x is None, x or 0))
    files = store(token_files.write_token_files(df, new_path(spark, "t"), files=2), "m")
    assert every(token_files.read_token_files(files).select("doc_id")) == ids
    assert {r[0] for r in packing.pack(df).select("doc_id").collect()} == set(ids)
    assert every(simhash.near_duplicates(df).select("doc_id")) == ids
    pages = df.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit("u")).withColumn("html", F.col("text"))
    assert every(html_text.extract_main_text(pages).select("page_id")) == ids
    assert every(url_filter.url_verdicts(pages).select("page_id")) == ids
    assert every(quality.host_quality(df).select("doc_id")) == ids
    assert every(lm.score_texts(df).select("doc_id")) == ids
    scored = toxicity.score_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert every(scored.select("doc_id")) == ids and scored.filter("held_out is null").count() == 0
    turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert {r[0] for r in chat.read_chats(chat.format_chats(turns)).select("conv_id").collect()} == set(ids)


# --- 3 packing

def test_packing_tiles_the_stream(spark):
    got = packing.pack(frame(spark, TEXTS).repartition(3), sequence=64).orderBy("sequence_id", "offset").collect()
    tok = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    at = 0
    for r in got:
        assert r["sequence_id"] * 64 + r["offset"] == at
        at += r["length"]
    for d, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u2").tolist()] == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    assert packing.pack(frame(spark, [])).count() == 0


# --- 4 near-duplicates

def brute_fingerprint(text, width=4):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, limit=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = list(TEXTS)
    for k in range(30):
        w = PROSE.split()
        w[int(rng.integers(400))] = f"new{k}"
        texts.append(" ".join(w))
    got = simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    fps = [brute_fingerprint(t) for t in texts]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in got] == brute_components(fps)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_dedup_keeps_documents_without_an_id(spark):
    rng = np.random.default_rng(11)
    prose = [" ".join(rng.choice([f"v{i}" for i in range(400)], 200)) for _ in range(5)]
    docs = [
        (4, prose[0], "first"), (2, prose[0], "least id"), (None, prose[0], "copy of a named one"), (None, prose[1], "alone"),
        (None, prose[2] + " b", "later"), (None, prose[2] + " a", "smallest"), (None, prose[2] + " a", "smallest"), (7, prose[3], "alone"), (None, None, "null"), (None, "", "null"),
        (7, prose[3], "alone"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, note string").withColumn("root", F.lit(1)).withColumn("fp", F.array(F.lit("x")))
    linked = bin(brute_fingerprint(docs[4][1]) ^ brute_fingerprint(docs[5][1])).count("1") <= 4
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    want = [(2, "least id"), (7, "alone"), (None, "alone"), (None, "smallest"), (None, "null")] + ([] if linked else [(None, "later")])
    assert rows(out, "doc_id", "note") == rows(spark.createDataFrame(want, "doc_id long, note string"), "doc_id", "note")
    assert simhash.drop_near_duplicates(df.filter("doc_id is not null")).count() == 2


def test_pipeline_drops_copies_of_shingle_similarity(spark):
    import corpus_pipeline

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def alike(x, y):
        return 5 * len(x & y) >= 4 * len(x | y)

    rng = np.random.default_rng(5)
    texts = [None, "", "a b", "A b", "a b c"]
    for g in range(12):  # chains and stars of copies at similarities from 0.6 to 1
        base = list(rng.choice([f"v{i}" for i in range(900)], 300))
        texts.append(" ".join(base))
        for k in range(10):
            w = list(base)
            for at in rng.choice(300, int(rng.integers(1, 15)), replace=False):
                w[at] = f"new{g}x{k}x{at}"
            texts.append(" ".join(w))
            base = w if g % 2 else base
    sets = [shingles(t) for t in texts]
    near = [[j for j, y in enumerate(sets) if x == y or alike(x, y)] for x in sets]
    root = list(range(len(texts)))
    for _ in texts:  # the smallest label spreads along links
        root = [min(root[j] for j in js) for js in near]
    out = corpus_pipeline.simhash_dedup(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(set(root))
    far = [i for i in range(len(texts)) for j in near[i] if bin(brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).count("1") > 4]
    assert far  # such copies are out of the four bits' reach


def test_near_copies_link_through_their_fingerprints(spark):
    from parlance.llm import near_copies

    rng = np.random.default_rng(8)
    base = list(rng.choice([f"v{i}" for i in range(900)], 600))
    texts = [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join(rng.choice(base, 600)), "", "a b"]
    docs = frame(spark, texts)
    prints = near_copies.signatures(docs, 5, "doc_id", "text")
    fps = [r["fp"] for r in prints.orderBy("doc_id").collect()]
    for fp, t in zip(fps, texts):
        s = [int(h) for h in near_copies.shingle_set(t)]
        assert fp % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s))
    assert bin(fps[0] % (1 << 64) ^ fps[1] % (1 << 64)).count("1") <= 4
    # no two sets share a band, so that only the fingerprints can bring copies together
    alone = near_copies.store(prints.withColumns({f"b{i}": F.col("doc_id") * 100 + i for i in range(near_copies.BANDS)}), "alone")
    got = {r["component_id"] for r in near_copies.near_copy_classes(docs, alone, 5, (4, 5), "text").collect()}
    assert got == {0, 2, 3, 4}


@pytest.mark.parametrize("block", [4, 1024])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = np.random.default_rng(5)
    fps = [int(rng.integers(0, 1 << 63)) for _ in range(40)]
    for base in fps[:6]:
        x = base
        for _ in range(25):  # chains and clouds around a centre
            y = x if rng.random() < 0.5 else base
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
            x = y
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.fingerprint_links(df, 4, block=block)  # with blocks of 4, most buckets go through the stars
    for r in links.collect():
        assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    want = brute_components(fps)
    groups = {}
    for f, c in zip(signed, want):
        groups.setdefault(c, []).append(f)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_a_path_a_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5 URL filter

def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (0, "http://a.net/x", ""), (1, "https://b.example.net/en/1?q", ""), (2, "http://EXAMPLE.com/de/2#f", ""), (3, "http://x.org/fr/1", ""),
        (4, None, None), (5, "nothing", ""), (6, "http://free.io/a", link("http://bad.net/z")), (7, "http://other.io/b", link("http://free.io/a")),
        (8, "http://ok.io/c", link("http://y.org/fr/9")), (9, "http://mixed.io/d", link("http://ok.io/c") + '<meta http-equiv="refresh" content="0; url=http://q.net/1">'),
        (10, "http://myexample.com/de/", ""), (11, "http://a.net", ""), (10, "http://myexample.com/de/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(df).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/2", "example.com/de/", "block")
    assert got[3] == ("x.org", "/fr/1", "org/fr/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == got[7][2:] == (None, "block")  # through aliases
    assert got[8][3] == got[9][3] == "allow"  # an explicit allow outranks a block by alias
    assert got[10][3] == "allow" and got[11] == ("a.net", "", None, "allow")
    assert url_filter.url_verdicts(df.limit(0)).count() == 0
    assert url_filter.url_verdicts(df).count() == len(pages)


def test_links_are_resolved_and_both_ends_judged(spark):
    link = '<LINK href="{}" rel=canonical>'.format
    refresh = "<meta content='0;URL={}' http-equiv=refresh>".format
    assert url_filter.link_targets("http://free.io/x/y?q", link("//bad.net/z") + link("../w") + link("p.html#f") + refresh("/r&amp;s") + "<link rel=icon href=i>") == [
        "http://bad.net/z", "http://free.io/w", "http://free.io/x/p.html#f", "http://free.io/r&s",
    ]
    pages = [
        (0, "http://free.io/a", link("//bad.net/z")), (1, "http://free.io/x/b", refresh("c")), (2, "http://free.io/x/c", link("http:&#x2f;/bad.net/q")), (3, "http://free.io/d", None),
        (4, "http://free.io/e", "a page about canonical things to refresh"), (5, "http://free.io/f", link("http://[")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://bad.net/1", "http://free.io/d"), (None, "http://free.io/e")], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(df, redirects=moved).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


# --- 6 main text

def test_main_text_of_pages():
    body = "A long paragraph of running text that goes on for quite some time and says things. "
    page = f"""<html><head><title>No</title><style>p{{}}</style><script>var x='</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p><b>{body}<br>more<p>{body}</p><p>Short.</p>
    <form>Name <input></form><p>{body}</p></article><div class="comments"><p>{body}</p></div><aside>{body}</aside><footer>&copy; me</footer>"""
    b = body.strip()
    assert html_text.main_text(page) == f"Head & line {b} more {b} Short. {b}"
    plain = f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div><p>{body}</p><p>{body}</p><p>End.</p></div><div class='footer'>x</div></body>"
    assert html_text.main_text(plain) == f"{b} {b} End."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""


def stripped(page):
    """Article markup, furniture elements and class names gone: only line lengths, headings and links are left."""
    for a, b in (("article", "div"), ("nav", "div"), ("footer", "div"), ("aside", "div")):
        page = page.replace(f"<{a}>", f"<{b}>").replace(f"</{a}>", f"</{b}>")
    return re.sub(r' class="[^"]*"', "", page)


def test_windows_find_the_text_without_article_markup():
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(rng.choice([f"word{i}" for i in range(300)], n))
    precision, recall = [], []
    for _ in range(60):
        paragraphs = [words(int(rng.integers(2, 90))) + "." for _ in range(int(rng.integers(2, 14)))]
        menu = "".join(f"<li><a href=/{i}>{words(1)}</a></li>" for i in range(int(rng.integers(3, 12))))
        body = f"<h1>{words(6)}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        tail = "".join(f"<div>{words(1)}</div>" for _ in range(8))
        page = f'<nav><ul>{menu}</ul></nav><div class="ad">{words(4)}</div><article>{body}</article><div class="related">{tail}</div><footer>{words(3)}</footer>'
        want = re.sub(r"<[^>]+>", " ", body).split()
        assert html_text.main_text(page).split() == want
        got = html_text.main_text(stripped(page)).split()
        common = sum((Counter(want) & Counter(got)).values())
        precision.append(common / max(1, len(got)))
        recall.append(common / len(want))
    assert np.mean(recall) > 0.97 and np.mean(precision) > 0.95, (np.mean(precision), np.mean(recall))


def test_window_sums_and_typical_window_by_brute_force():
    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 40):
        sizes = rng.integers(0, 200, n)
        sizes[0] = 7
        sums = html_text.window_sums(sizes)
        assert sums.tolist() == [int(sizes[i : i + html_text.WINDOW].sum()) for i in range(n)]
        characters = sorted(int(s) for s, k in zip(sums, sizes) for _ in range(k))
        assert html_text.typical_window(sizes, sums) == characters[(len(characters) + 1) // 2 - 1]


def test_teasers_and_edges():
    body = "A long paragraph of running text that goes on for quite some time and says things. "
    teaser = "<article><p>Short.</p></article>"
    assert html_text.main_text(f"{teaser}<div><p>{body * 4}</p><p>{body * 4}</p></div>{teaser}".replace("<p>Short.</p>", "<p>x</p>")) == (body * 8).strip()
    page = f"<body><p>Short para one.</p><p>ab.</p><p>cd.</p><p>{body * 3}</p><p>{body}</p><div>x</div><div>y</div><div>menu</div>"
    assert html_text.main_text(page) == f"Short para one. ab. cd. {(body * 4).strip()}"
    assert html_text.main_text("<div>a</div><div>b</div>") == "a b" or html_text.main_text("<div>a</div><div>b</div>") == ""


def test_main_text_query_handles_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", "<article><p>Hé &lt;b&gt;\n x</p></article>"), (2, "u", "<p>a</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert rows(html_text.extract_main_text(df), "page_id", "text", "n_chars") == [(1, "", 0), (2, "Hé <b> x", 8), (2, "a", 1)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


# --- 7 quality

def test_quality_equals_sql(spark, tmp_path):
    import duckdb

    texts = TEXTS + ["# * " * 80 + PROSE, "line\n" * 90, "a b c d e f " * 30]
    df = frame(spark, texts).unionByName(frame(spark, ["#x " * 100] * 9, "b").withColumn("doc_id", F.col("doc_id") + 100)).unionByName(frame(spark, [PROSE], None).withColumn("doc_id", F.col("doc_id") + 200))
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM documents")
    cur = con.execute(quality.ORACLE)
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in quality.host_quality(df).select(*cols).collect()), key=str) == want
    kept = quality.drop_low_quality(df)
    assert kept.columns == df.columns and kept.count() == sum(r[cols.index("kept")] for r in want)
    assert quality.host_quality(frame(spark, [])).count() == 0


# --- 8 language model

def coded(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return b" ".join([*(text or "").encode().translate(low).split(), b"\n"])


def context_tree_scores(texts, train, depth):
    """Scores by a dictionary of nodes (depth, context, bits so far), counted position by position."""
    counts, children = {}, {}

    def path(body, i):
        context = (b"\n" * depth + body)[i : i + depth]
        for b in range(8):
            u = 1 << b | body[i] >> (8 - b)
            yield [(d, context[depth - d :], u) for d in range(depth + 1)], body[i] >> (7 - b) & 1

    for t in train:
        body = coded(texts[t])
        for i in range(len(body)):
            for nodes, bit in path(body, i):
                for k in nodes:
                    counts.setdefault(k, [0, 0])[bit] += 1
    for d, context, u in counts:
        if d:
            children.setdefault((d - 1, context[1:], u), []).append((d, context, u))
    own, weighted = {}, {}
    for k in sorted(counts, key=lambda k: -k[0]):
        a, b = counts[k]
        own[k] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        weighted[k] = own[k] if k[0] == depth else np.logaddexp(own[k], sum(weighted[x] for x in children[k])) - math.log(2)
    out = []
    for t in texts:
        body, total = coded(t), 0.0
        for i in range(len(body)):
            for nodes, bit in path(body, i):
                p, below = 0.5, False
                for k in (k for k in reversed(nodes) if k in counts):
                    a, b = counts[k]
                    stop = math.exp(own[k] - math.log(2) - weighted[k]) if below else 1.0
                    p, below = stop * (counts[k][bit] + 0.5) / (a + b + 1) + (1 - stop) * p, True
                total += math.log10(p)
        out.append((total, -total / math.log10(2) / len(body)))
    return out


LM_TEXTS = [f"the cat sat on mat {i % 7} again" for i in range(60)] + [None, "", "THE Cat", "zebra unseen words", "\u00d6l und B\u00f6\nzwei  Leer", "the cat sat on mat 3 again"]


@pytest.mark.parametrize("depth,part,block,chunk", [(6, 2_000_000, 4 << 20, 32 << 20), (3, 50, 64, 300), (5, 200, 100, 1000)])
def test_language_model_equals_sequential_context_tree(spark, monkeypatch, depth, part, block, chunk):
    for name, value in (("PART_ROWS", part), ("BLOCK_BYTES", block), ("CHUNK_BYTES", chunk), ("SAMPLE", 4 if part < 1000 else 4096)):
        monkeypatch.setattr(lm, name, value)
    got = {r["doc_id"]: r for r in lm.score_texts(frame(spark, LM_TEXTS).repartition(3), depth=depth).collect()}
    train = [i for i in range(len(LM_TEXTS)) if zlib.crc32(str(i).encode()) % 7 != 2]
    for i, (score, bits) in enumerate(context_tree_scores(LM_TEXTS, train, depth)):
        assert abs(got[i]["score"] - score) < 1e-5 and abs(got[i]["bits_per_byte"] - bits) < 1e-6


def test_context_tree_probabilities_sum_to_one():
    """Over all bytes after a context, whether training saw it or not."""
    train = coded("the then there cat the cat")
    for context in (b"the", b"\n\n\n", b"zzz", b"xhe"):
        win = np.arange(256, dtype=np.uint64) | np.uint64(context[2] << 24 | context[1] << 16 | context[0] << 8)
        seen = lm.block_windows(b"\n\n\n" + train, np.array([3 + len(train)]), 3)
        every, n = lm.summed(np.concatenate([seen, win]), np.concatenate([np.ones(len(seen)), np.zeros(256)]))
        trees = lm.Trees(every, n, 3, True)
        keys, n0, n1, below = (np.concatenate(x) for x in list(zip(*trees.two))[1:])
        keys, n0, n1, below = lm.summed(keys, n0, n1, below)
        two = lm.Nodes(n0, n1, below)  # a mixture that starts at depth 2
        lp = trees.log_probabilities(keys, two.stop * two.one, 1 - two.stop, np.where(two.seen, two.one, 0.5), every)
        assert abs((10 ** lp[np.isin(every, win)]).sum() - 1) < 1e-9


def test_kt_is_the_sequential_estimate():
    p, n = 0.0, [0, 0]
    for bit in [0, 1, 1, 0, 1, 1, 1]:
        p += np.log((n[bit] + 0.5) / (sum(n) + 1))
        n[bit] += 1
    assert abs(lm.kt(np.array([n[0]]), np.array([n[1]]))[0] - p) < 1e-9
    for a, b in ((70_000, 3), (65_535, 65_537), (10**7, 10**8)):  # past the table
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        assert abs(lm.kt(np.array([a]), np.array([b]))[0] / want - 1) < 1e-9


def test_language_model_base_and_edge_cases(spark):
    df = frame(spark, LM_TEXTS).unionByName(spark.createDataFrame([(None, "no id", "a", "x", 1, "y"), (None, "no id", "a", "x", 1, "y")], DOCS)).unionByName(frame(spark, LM_TEXTS[:2]))
    texts = [*enumerate(LM_TEXTS), (None, "no id"), (None, "no id"), *enumerate(LM_TEXTS[:2])]
    got = lm.score_texts(df.withColumn("chunk", F.lit(1)).withColumn("score", F.lit("clash"))).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in texts if not held(i) for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want.append((i, held(i), len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    key = lambda x: tuple((y is None, y) for y in x)
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], key=key) == sorted(want, key=key)
    assert lm.score_texts(frame(spark, [])).count() == 0
    held_only = spark.createDataFrame([(next(i for i in range(99) if held(i)), "ab c")], "doc_id long, text string")
    r = lm.score_texts(held_only).first()
    assert r["train_tokens"] == 0 and abs(r["bits_per_byte"] - 8) < 1e-6  # without training every bit costs one bit


# --- 9 toxicity

def test_toxicity_learns_planted_words(spark):
    rng = np.random.default_rng(0)
    vocab = [f"plain{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(vocab, int(rng.integers(20, 120))))
        if i % 4 == 0:
            for _ in range(3):
                w[int(rng.integers(len(w)))] = str(rng.choice(["vilename", "scoundrel", "wretch"]))
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    texts += [None, "", PROSE * 50]
    got = toxicity.score_toxicity(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.9
    assert len(got) == len(texts) and got[400]["score"] == got[401]["score"]
    none = toxicity.score_toxicity(frame(spark, TEXTS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == len(TEXTS)


def test_toxicity_sample_is_bounded_and_each_id_trains_once(spark):
    docs = [(i, f"text {i}") for i in range(100)] * 3 + [(i, f"other {i}") for i in range(100)] + [(None, "no id"), (200, "long " * 40), (201, None)]
    labels = [(i, i % 2) for i in range(100)] + [(0, 1), (200, 1), (201, 0), (None, 1), (300, 1), (5, None)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.training_rows(d, lab, 20, 50, 5, 0).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and 200 not in ids
    assert Counter(r["toxic"] for r in got) == {0: 20, 1: 20} or all(v <= 20 for v in Counter(r["toxic"] for r in got).values())
    assert all(r["text"] in (f"other {r['doc_id']}", "") for r in got)
    out = toxicity.drop_toxic(d.withColumn("score", F.lit("x")), lab, fit_docs=20, fit_chars=50)
    assert out.columns == ["doc_id", "text", "score"]


def test_recurrent_gradients_match_differences():
    rng = np.random.default_rng(0)
    d = toxicity.WORD_DIM + toxicity.CHAR_DIM
    p = {k: rng.normal(0, 0.5, s) for k, s in (("W", (d, 24)), ("U", (8, 24)), ("b", (24,)))}
    x, mask = rng.normal(size=(5, 3, d)), np.ones((5, 3, 1))
    mask[3:, 1] = 0
    r = rng.normal(size=(5, 3, 8))
    kept = []
    toxicity.gru(x, mask, p, kept)
    _, g = toxicity.gru_back(r, x, mask, p, kept)
    for k, at in (("W", (2, 3)), ("W", (1, 20)), ("U", (3, 10)), ("U", (2, 22)), ("b", (9,))):
        eps, old = 1e-3, p[k][at]
        p[k][at] = old + eps
        hi = (toxicity.gru(x, mask, p) * r).sum()
        p[k][at] = old - eps
        lo = (toxicity.gru(x, mask, p) * r).sum()
        p[k][at] = old
        assert abs((hi - lo) / (2 * eps) - g[k][at]) < 1e-2 * max(1, abs(g[k][at]))


# --- 10 chat

def test_chat_round_trip_and_states(spark):
    said = "<|im_end|>\n<|im_start|>assistant\nok \\ \\n <\\|x"
    turns = [
        (1, 0, "user", said), (1, 1, "assistant", said), (2, 1, "assistant", "b"), (2, 0, "system", None), (3, 0, "user", "u"), (4, 0, "odd\nrole", ""),
        (None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "same"), (5, 0, "user", "same"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(9))
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in (1, 2, 3, 4, None, 5):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1], t[2], t[3] or ""))
        whole = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["error"] is None and got[2]["error"] == "assistant after system" and got[3]["error"] == "ends after user"
    assert got[4]["error"] == "odd\nrole after start" and got[5]["error"] == "user after user"
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


# --- pipeline

def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    vocab = [f"plain{i}" for i in range(500)]
    prose = lambda n: list(rng.choice(vocab, n))
    item = " ".join(prose(30))
    texts, toxic = [], set()
    for i in range(240):
        w = prose(120)
        if i % 3 == 0:
            toxic.add(i)
            for k in (5, 50, 100):
                w[k] = "vilename"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1] + " tail", " ".join(prose(60)) + " " + item + " " + " ".join(prose(60)), "too short", None, "a b c " * 80]
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d)
    kept = {r[0] for r in got.select("doc_id").distinct().collect()}
    assert kept == {i for i in range(240) if i not in toxic}
    now = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now.limit(0), d)
        assert out.columns == now.columns and out.count() == 0


# --- what the methods decide

def test_main_text_needs_its_windows(monkeypatch):
    """The article's marks bound what the windows find; without surging windows there is no text, marks or not."""
    body = "A long paragraph of running text that goes on for quite some time and says things. "
    page = f"<nav>menu</nav><article><h1>Head</h1><p>{body * 3}</p><p>x</p><p>{body}</p></article><div>{body}</div><article><p>tease</p></article>"
    assert html_text.main_text(page) == f"Head {(body * 3).strip()} x {body.strip()}"
    two = f"<article><p>{body * 3}</p></article><article><p>{body * 4}</p></article><article><p>tease</p></article>"
    assert html_text.main_text(two) == f"{(body * 3).strip()} {(body * 4).strip()}"
    monkeypatch.setattr(html_text, "SURGE", 1e9)
    assert html_text.main_text(page) == html_text.main_text(two) == ""


def test_quality_verdicts_depend_on_the_host(spark):
    """One document on two hosts: dropped where the host fails the rule often, kept where it does not; alike without leeway."""
    middling = "# * " * 45 + " ".join(f"wordish{i}" for i in range(95))  # 90 symbols in 185 words, just under half
    bad = "# * " * 95 + " ".join(f"w{i}" for i in range(30))
    hosts = {"often": [bad] * 30 + [PROSE] * 10, "never": [PROSE] * 40, "other": [PROSE] * 39 + [bad]}
    df = None
    for h, (host, texts) in enumerate(hosts.items()):
        part = frame(spark, [middling, *texts], host).withColumn("doc_id", F.col("doc_id") + 1000 * h)
        df = part if df is None else df.unionByName(part)
    kept = {r["doc_id"]: r["kept"] for r in quality.host_quality(df).collect()}
    assert [kept[0], kept[1000], kept[2000]] == [False, True, True]
    plain = {r["doc_id"]: r["kept"] for r in quality.host_quality(df, leeway=1.0).collect()}
    assert [plain[0], plain[1000], plain[2000]] == [True, True, True]
    factors = {r["host"]: r["factor_symbols"] for r in quality.host_verdicts(quality.document_counts(df), 1.25).collect()}
    assert factors["often"] < 1 < factors["never"] and 0.8 <= min(factors.values()) and max(factors.values()) <= 1.25


def test_stages_take_null_ids_ties_and_repeats_together(spark):
    """Every stage but the last on documents with null ids, repeated rows, rows of one id and clashing columns: columns stay, nothing fails."""
    import corpus_pipeline

    rows_ = [(None, PROSE), (None, PROSE), (1, PROSE), (1, PROSE + " end"), (2, None), (2, ""), (3, "x " * 60_000), (4, PROSE)]
    docs = spark.createDataFrame([(i, t, "a", "x", 1, "y") for i, t in rows_], DOCS)
    benchmark = spark.createDataFrame([(1, "not in any of them at all")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    path = new_path(spark, "sf")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and stage(spark, docs.limit(0), path).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    whole = Counter()
    for r in packed:
        whole[r["doc_id"]] += r["length"]
    tok = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows_:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert whole == want


def test_workers_give_memory_back_after_every_batch(monkeypatch):
    """Idle workers share an executor's memory: heap pages go back, not only Arrow's pool."""
    import pyarrow as pa
    from parlance.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 100, None, "b" * 100]})
    assert [s.num_rows for s in common.sliced(iter([batch, batch]), 0, 150)] == [2, 1, 2, 1]
    assert len(calls) == 2
