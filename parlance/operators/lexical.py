"""Language-model and lexicon statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pron_bigrams(prons: DataFrame, eps: str = "<eps>") -> DataFrame:
    """Counts of neighbouring word-prons (v, w) of each utterance, silences removed, with ``<s>`` and ``</s>`` around."""
    w = Window.partitionBy("utt").orderBy("pos")
    x = prons.select("utt", "pos", F.when(F.col("word") != eps, F.col("word")).alias("word"))
    x = x.withColumn("before", F.expr("lag(word) ignore nulls over (partition by utt order by pos)")).withColumn("after", F.expr("lead(word) ignore nulls over (partition by utt order by pos)"))
    x = x.withColumn("head", F.lag(F.lit(1)).over(w).isNull())
    pair = lambda v, w: F.struct(v.alias("v"), w.alias("w"))
    start, end, real = F.lit("<s>"), F.lit("</s>"), F.col("word").isNotNull()
    rows = [
        F.when(real, pair(F.col("word"), F.coalesce("after", end))),
        F.when(real & F.col("before").isNull(), pair(start, F.col("word"))),
        F.when(F.col("head") & ~real & F.col("after").isNull(), pair(start, end)),  # nothing but silence
    ]
    return x.select(F.inline(F.array_compact(F.array(*rows)))).groupBy("v", "w").agg(F.count("*").alias("n"))


def unigram_model(text: DataFrame) -> DataFrame:
    """Cost -ln p of each word of the texts (words) and of the end, in one total of tokens and lines."""
    n = text.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = n.unionByName(text.agg(F.count("*").alias("n")).select(F.lit("</s>").alias("word"), "n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("word", F.log(F.col("t") / F.col("n")).alias("cost"))  # one row


def bigram_model(words: DataFrame) -> DataFrame:
    """Cost -ln(count / history count) of neighbouring words, with ``<s>`` and ``</s>``."""
    b = pron_bigrams(words.select("utt", "pos", "word"))
    return b.select("v", "w", F.log(F.sum("n").over(Window.partitionBy("v")) / F.col("n")).alias("cost"))


def ngrams(text: DataFrame, n: int) -> DataFrame:
    """Counts of the n-grams of texts (words), space-joined.

    The word array is laid beside its own shifts and inlined, which is compiled code; words are joined after counting.
    Shorter texts have empty shifts, so no filter on the words makes them a second time.
    """
    full = F.greatest(F.size("words") - (n - 1), F.lit(0))
    shifts = F.arrays_zip(*[F.slice("words", F.lit(i + 1), full).alias(f"w{i}") for i in range(n)])
    names = [f"w{i}" for i in range(n)]
    return text.select(F.inline(shifts)).groupBy(*names).agg(F.count("*").alias("n")).select(F.concat_ws(" ", *names).alias("gram"), "n")


def example_keywords(text: DataFrame, wants: tuple = ((1, 20, 20), (2, 4, 20), (3, 3, 10)), most: int = 100) -> DataFrame:
    """For each order: the rarest n-grams with a count from the least to ``most``; ties in byte order."""
    out = None
    for n, least, k in wants:
        got = ngrams(text, n).filter(F.col("n").between(least, most)).orderBy("n", "gram").limit(k).select(F.lit(n).alias("len"), "gram", "n")
        out = got if out is None else out.unionByName(got)
    return out


def utterance_mix(text: DataFrame, top: DataFrame) -> DataFrame:
    """Per utterance: probability of each top word (word, p) plus 1 / length for each own occurrence."""
    own = text.select("utt", F.explode("words").alias("word"), (1.0 / F.size("words")).alias("p"))
    every = text.select("utt").join(F.broadcast(top.select("word", "p")))  # a top list of fixed length
    return own.unionByName(every).groupBy("utt", "word").agg(F.sum("p").alias("p"))


def class_probs(counts: DataFrame, nwords: int) -> DataFrame:
    """Words beyond the ``nwords`` most frequent share a class; probability of each within it."""
    r = counts.orderBy(F.desc("n"), "word").limit(nwords).select("word")
    rest = counts.join(r, "word", "left_anti")
    return rest.join(F.broadcast(rest.agg(F.sum("n").alias("t")))).select("word", (F.col("n") / F.col("t")).alias("p"))  # one row


def oov_logprob(words: DataFrame, vocabulary: DataFrame, probs: DataFrame, floor: float = 1e-7) -> DataFrame:
    """Per utterance, the sum of ln p of its unknown words within their class."""
    w = words.join(vocabulary.select("word"), "word", "left_anti").join(probs.select("word", "p"), "word", "left")
    s = w.groupBy("utt").agg(F.sum(F.log(F.coalesce("p", F.lit(floor)))).alias("logprob"))
    return words.select("utt").distinct().join(s, "utt", "left").select("utt", F.coalesce("logprob", F.lit(0.0)).alias("logprob"))


def arpa_oovs(arpa: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words of an n-gram table (n, words, logprob, backoff) that the vocabulary lacks, sentence ends aside."""
    w = arpa.filter("n = 1").select(F.col("words")[0].alias("word")).filter(~F.col("word").isin("<s>", "</s>"))
    return w.join(vocabulary.select("word"), "word", "left_anti")


def map_arpa(arpa: DataFrame, symtab: DataFrame) -> DataFrame:
    """N-grams with words as ids; those with an unknown word are dropped."""
    a = arpa.withColumn("_k", F.xxhash64(F.array_join("words", " "))).select("*", F.posexplode("words").alias("_p", "sym"))
    m = a.join(symtab, "sym", "left").groupBy("n", "words", "logprob", "backoff").agg(F.array_sort(F.collect_list(F.struct("_p", "id"))).alias("l"))
    return m.filter(~F.exists("l", lambda x: x["id"].isNull())).filter(F.size("l") == F.col("n")).select("n", F.transform("l", lambda x: x["id"]).alias("ids"), "logprob", "backoff")


def symbol_table(words: DataFrame) -> DataFrame:
    """Distinct words in byte order numbered from 3 after ``<eps>``, ``<unk>`` and ``SIL``; ``#0`` is last."""
    from .helpers import numbered

    bad = F.when(F.col("word").isin("<s>", "</s>"), F.raise_error(F.concat(F.lit("reserved word "), "word")).cast("string")).otherwise(F.col("word"))
    w = numbered(words.select(bad.alias("sym")).distinct(), ["sym"], "id").select("sym", (F.col("id") + 2).alias("id"))
    head = words.sparkSession.createDataFrame([("<eps>", 0), ("<unk>", 1), ("SIL", 2)], "sym string, id long")
    return head.unionByName(w).unionByName(w.agg((F.max("id") + 1).alias("id")).select(F.lit("#0").alias("sym"), F.coalesce("id", F.lit(3)).alias("id")))


def disambiguate(lexicon: DataFrame) -> DataFrame:
    """Mark pronunciations that others share or begin with: ``#k``, counted per pronunciation in word order."""
    lx = lexicon.select("word", F.array_join("phones", " ").alias("p"), "phones")
    n = F.sequence(F.lit(1), F.size("phones") - 1)
    prefix = lx.filter(F.size("phones") > 1).select(F.explode(F.transform(n, lambda i: F.array_join(F.slice("phones", F.lit(1), i), " "))).alias("p")).distinct()
    lx = lx.join(prefix.withColumn("_pre", F.lit(True)), "p", "left")
    w = Window.partitionBy("p")
    k = F.row_number().over(w.orderBy("word"))
    mark = (F.count("*").over(w) > 1) | F.col("_pre")
    return lx.withColumn("_k", k).withColumn("_m", mark).select("word", F.when(F.col("_m"), F.concat("p", F.lit(" #"), "_k")).otherwise(F.col("p")).alias("pron"))


def suffix_rules(lexicon: DataFrame, min_prefix: int = 3, min_count: int = 20, max_suffix: int = 4) -> DataFrame:
    """Rules (suffix, base_suffix, psuffix, base_psuffix) by which words of one stem and their prons differ, seen often.

    A word is cut into stem and suffix at each place past ``min_prefix`` letters; only frequent suffixes meet on
    their stems, so a stem's words are paired after the rare ones are gone. Phone stems are the longest common
    start of the two prons.
    """
    n = F.sequence(F.greatest(F.lit(min_prefix), F.length("word") - max_suffix), F.length("word"))
    cut = lexicon.filter(F.length("word") >= min_prefix).select("word", "phones", F.explode(n).alias("i"))
    cut = cut.select("word", "phones", F.expr("substring(word, 1, i)").alias("stem"), F.expr("substring(word, i + 1)").alias("suffix"))
    often = cut.groupBy("suffix").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("suffix")
    cut = cut.join(often, "suffix", "left_semi")
    a = cut.select("stem", "suffix", F.col("phones").alias("pa"))
    b = cut.select("stem", F.col("suffix").alias("base_suffix"), F.col("phones").alias("pb"))
    differ = (F.col("suffix") != F.col("base_suffix")) & ((F.substring("suffix", 1, 1) != F.substring("base_suffix", 1, 1)) | (F.col("suffix") == "") | (F.col("base_suffix") == ""))
    pair = a.join(b, "stem").filter(differ)
    bare = lambda p: F.regexp_replace(p, "[0-9]", "")
    short = F.least(F.size("pa"), F.size("pb"))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (i <= short) & (bare(F.get("pa", i - 1)) == bare(F.get("pb", i - 1))), i).otherwise(s))
    pair = pair.withColumn("_c", common)
    tail = lambda x: F.array_join(F.slice(x, F.col("_c") + 1, F.greatest(F.size(x) - F.col("_c"), F.lit(0))), "_")
    rules = pair.select("suffix", "base_suffix", tail("pa").alias("psuffix"), tail("pb").alias("base_psuffix"))
    return rules.groupBy("suffix", "base_suffix", "psuffix", "base_psuffix").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def rule_hierarchy(rules: DataFrame) -> DataFrame:
    """Pairs of rules (id of the specific, id of the general) where trimming common leading letters makes one the other."""
    r = rules.select("suffix", "base_suffix", "psuffix", "base_psuffix")
    k = F.least(F.length("suffix"), F.length("base_suffix"))
    trimmed = r.withColumn("i", F.explode(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))))
    trimmed = trimmed.filter("substring(suffix, 1, i) = substring(base_suffix, 1, i)")
    key = lambda s, b, p, q: F.concat_ws(",", s, b, p, q)
    general = key(F.expr("substring(suffix, i + 1)"), F.expr("substring(base_suffix, i + 1)"), F.col("psuffix"), F.col("base_psuffix"))
    trimmed = trimmed.select(key("suffix", "base_suffix", "psuffix", "base_psuffix").alias("specific"), general.alias("general"))
    return trimmed.join(r.select(key("suffix", "base_suffix", "psuffix", "base_psuffix").alias("general")), "general", "left_semi").select("specific", "general")


def candidate_prons(words: DataFrame, rules: DataFrame, lexicon: DataFrame, min_prefix: int = 3, max_suffix: int = 4) -> DataFrame:
    """Pronunciations of words by rule: stem + suffix has that of stem + base suffix with its phone ending replaced.

    A candidate with secondary stress also comes without it (2 becomes 1, ``destress`` yes).
    """
    n = F.sequence(F.greatest(F.lit(min_prefix), F.length("word") - max_suffix), F.length("word"))
    cut = words.select("word").filter(F.length("word") >= min_prefix).select("word", F.explode(n).alias("i"))
    cut = cut.select("word", F.expr("substring(word, 1, i)").alias("stem"), F.expr("substring(word, i + 1)").alias("suffix"))
    j = cut.join(rules.select("suffix", "base_suffix", "psuffix", "base_psuffix"), "suffix").withColumn("base_word", F.concat("stem", "base_suffix"))
    j = j.join(lexicon.select(F.col("word").alias("base_word"), F.array_join("phones", "_").alias("base_pron")), "base_word")
    ends = (F.col("base_psuffix") == "") | F.concat(F.lit("_"), "base_pron").endswith(F.concat(F.lit("_"), F.col("base_psuffix")))
    stem = F.expr("rtrim('_', substring(base_pron, 1, length(base_pron) - length(base_psuffix)))")
    pron = F.regexp_replace(F.concat_ws("_", stem, F.expr("nullif(psuffix, '')")), "^_", "")
    rule = F.concat_ws(",", "suffix", "base_suffix", "psuffix", "base_psuffix")
    out = j.filter(ends).select("word", F.translate(pron, "_", " ").alias("pron"), "base_word", F.translate("base_pron", "_", " ").alias("base_pron"), rule.alias("rule"))
    flat = out.filter(F.col("pron").contains("2")).withColumn("pron", F.translate("pron", "2", "1")).withColumn("destress", F.lit("yes"))
    return out.withColumn("destress", F.lit("no")).unionByName(flat)


def limit_to_specific(cands: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Candidates without those to which a more specific rule of the same word, base and stress choice applied."""
    beaten = cands.select("word", "base_word", "destress", F.col("rule").alias("specific")).join(hierarchy, "specific").select("word", "base_word", "destress", F.col("general").alias("rule"))
    return cands.join(beaten, ["word", "base_word", "destress", "rule"], "left_anti")


def acronym_prons(words: DataFrame, letters: DataFrame) -> DataFrame:
    """Letter-by-letter prons of one to five capitals or dotted letters; doubled letters also as ``double``, tripled as ``triple``.

    ``letters`` has letter and phones; the entries ``double`` and ``triple`` hold those words.
    """
    w = words.select("word").filter(F.col("word").rlike(r"^([A-Z]{1,5}|([A-Z]\.){1,5})$")).withColumn("s", F.regexp_replace("word", r"\.", ""))
    runs = F.regexp_extract_all("s", F.lit(r"((.)\2*)"), 1)
    r = w.select("word", F.posexplode(runs).alias("p", "run")).withColumn("letter", F.substring("run", 1, 1)).withColumn("k", F.length("run"))
    spoken = letters.select("letter", F.array_join("phones", " ").alias("x"))
    one = {n: spoken.filter(F.col("letter") == n).select(F.col("x").alias(n)) for n in ("double", "triple")}
    r = r.join(F.broadcast(spoken), "letter").join(F.broadcast(one["double"]), how="left").join(F.broadcast(one["triple"]), how="left")  # an alphabet
    plain = F.array_join(F.array_repeat("x", F.col("k")), " ")
    options = F.when(F.col("k") == 2, F.array(plain, F.concat_ws(" ", "double", "x"))).when(F.col("k") == 3, F.array(plain, F.concat_ws(" ", "triple", "x"))).otherwise(F.array(plain))
    g = r.withColumn("o", options).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "o"))), lambda z: z["o"]).alias("os"))
    product = F.aggregate("os", F.array(F.lit("")), lambda s, o: F.flatten(F.transform(s, lambda a: F.transform(o, lambda b: F.ltrim(F.concat(a, F.lit(" "), b))))))
    return g.select("word", F.explode(product).alias("pron"))


def stress_questions(phones: DataFrame) -> DataFrame:
    """Phones that share a base symbol, and phones that share a stress digit, as one line each."""
    base, digit = F.regexp_extract("phone", r"^([A-Za-z]+)", 1), F.regexp_extract("phone", r"(\d)$", 1)
    p = phones.select("phone").distinct()
    line = F.array_join(F.array_sort(F.collect_set("phone")), " ").alias("phones")
    return p.groupBy(F.concat(F.lit("base "), base).alias("question")).agg(line).unionByName(p.filter(digit != "").groupBy(F.concat(F.lit("stress "), digit).alias("question")).agg(line))


def keyword_table(keywords: DataFrame, symtab: DataFrame) -> DataFrame:
    """Keywords (text) numbered in byte order; those with an unknown word are dropped."""
    from .helpers import numbered

    w = keywords.select("text").distinct().select("text", F.explode(F.split("text", " ")).alias("sym"))
    bad = w.join(symtab, "sym", "left_anti").select("text").distinct()
    k = numbered(keywords.select("text").distinct(), ["text"], "n").withColumn("kwid", F.format_string("KW-%04d", F.col("n"))).drop("n")
    return k.join(bad, "text", "left_anti").select("kwid", "text")


def keyword_search(ctm: DataFrame, keywords: DataFrame, max_gap: float = 0.5) -> DataFrame:
    """Phrase hits in time-marked words (utt, pos, start, dur, word): each next word follows within ``max_gap``.

    Postings meet the distinct beginnings of keywords, first of one word, then position by position of one more, so
    a place in an utterance is one row however many keywords begin with its word. What is found meets the keywords' ids last.
    """
    from .helpers import small, store

    k = store(keywords.select("kwid", F.split("text", " ").alias("w")).withColumn("n", F.size("w")), "keywords")
    lengths = sorted(r[0] for r in k.filter("n > 0").select("n").distinct().collect())  # a few numbers
    used = small(k.select(F.explode("w").alias("word")).distinct())
    post = ctm.select("utt", "pos", "start", F.round(F.col("start") + F.col("dur"), 2).alias("end"), "word").join(used, "word", "left_semi")
    post = store(post, "postings")  # of the keywords' words only; read once for each position
    begun = lambda i: F.array_join(F.slice("w", 1, i), " ")
    hit = post.join(small(k.select(F.col("w")[0].alias("word")).distinct()), "word").select(F.col("word").alias("begun"), "utt", F.col("start").alias("tbeg"), "end", "pos")
    done = hit.limit(0).select(F.lit(None).cast(k.schema["kwid"].dataType).alias("kwid"), "utt", "tbeg", "end")
    for i in range(1, (lengths or [0])[-1] + 1):
        if i > 1:
            nxt = post.select("utt", (F.col("pos") - 1).alias("pos"), F.col("start").alias("s2"), F.col("end").alias("e2"), "word")
            steps = k.filter(F.col("n") >= i).select(begun(i - 1).alias("begun"), F.get("w", F.lit(i - 1)).alias("word"), begun(i).alias("longer")).distinct()
            hit = hit.join(nxt, ["utt", "pos"]).filter(F.round(F.col("s2") - F.col("end"), 2) <= max_gap).join(small(steps), ["begun", "word"])
            hit = hit.select(F.col("longer").alias("begun"), "utt", "tbeg", F.col("e2").alias("end"), (F.col("pos") + 1).alias("pos"))
        if i in lengths:
            done = done.unionByName(hit.join(small(k.filter(F.col("n") == i).select("kwid", begun(i).alias("begun"))), "begun").select("kwid", "utt", "tbeg", "end"))
    return done.select("kwid", "utt", "tbeg", F.round(F.col("end") - F.col("tbeg"), 2).alias("dur"))


def abbreviation_score(found: DataFrame, gold: DataFrame) -> DataFrame:
    """True and false positives of found long forms (long) against a gold list, without regard to case."""
    g = gold.select(F.lower("long").alias("_g")).distinct().withColumn("_ok", F.lit(True))
    j = found.join(g, F.lower("long") == F.col("_g"), "left")
    return j.agg(F.count("_ok").alias("tp"), F.count_if(F.col("_ok").isNull()).alias("fp"))


def reverse_arpa(arpa: DataFrame) -> DataFrame:
    """The n-gram model (n, words, logprob, backoff) that scores reversed sentences alike.

    A reversed n-gram scores p + b plus, for each shorter length, p of the n-gram's start less p of what follows its
    first word. N-grams that this or a backed-off reading needs and the model lacks join it with p = 0 and a backoff
    of -100000. Sentence ends swap; the weight of ``</s>``, which is read first, moves from the new ``<s>`` unigram
    (its backoff) to the bigrams that start with it. All lookups are joins on the words, of a model that is written
    once: what it is made from is not worked out again for each of them.
    """
    from .helpers import store

    arpa = store(arpa, "arpa")
    top = arpa.agg(F.max("n")).first()[0] or 0
    start = arpa.filter((F.col("n") == 1) & (F.col("words")[0] == "<s>")).agg(F.max("logprob")).first()[0]
    p = F.when((F.col("n") == 1) & (F.col("words")[0] == "<s>"), 0.0).otherwise(F.col("logprob"))
    real = arpa.select("n", F.array_join("words", " ").alias("g"), "words", p.alias("p"), F.coalesce("backoff", F.lit(0.0)).alias("b"))
    shorter = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1))
    x = real.select("words", "n", F.explode(shorter).alias("x"))
    subs = F.array(F.slice("words", F.lit(1), F.col("x")), F.slice("words", F.lit(2), F.col("x")), F.slice("words", F.col("n") - F.col("x") + 1, F.col("x")))
    subs = x.select(F.explode(subs).alias("words")).distinct().select(F.size("words").alias("n"), F.array_join("words", " ").alias("g"), "words")
    made = subs.join(real.select("g"), "g", "left_anti").select("n", "g", "words", F.lit(0.0).alias("p"), F.lit(None).cast("double").alias("b"))
    every = store(real.unionByName(made), "every")
    y = every.filter("n > 1").select("g", "words", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("x"))
    terms = y.select("g", F.array_join(F.slice("words", F.lit(1), F.col("x")), " ").alias("s"), F.lit(1).alias("sign")).unionByName(y.select("g", F.array_join(F.slice("words", F.lit(2), F.col("x")), " ").alias("s"), F.lit(-1).alias("sign")))
    sums = terms.join(every.select(F.col("g").alias("s"), F.col("p").alias("q")), "s").groupBy("g").agg(F.sum(F.col("sign") * F.col("q")).alias("t"))
    swap = lambda w: F.when(w == "<s>", "</s>").when(w == "</s>", "<s>").otherwise(w)
    out = every.join(sums, "g", "left").select("n", F.transform(F.reverse("words"), swap).alias("words"), (F.col("p") + F.coalesce("b", F.lit(0.0)) + F.coalesce("t", F.lit(0.0))).alias("r"), F.col("b").isNull().alias("made"))
    out = store(out, "reversed")
    first = F.col("words")[0] == "<s>"
    offset = out.filter((F.col("n") == 1) & first).agg(F.coalesce(F.max("r"), F.lit(0.0)).alias("offset"))
    out = out.join(F.broadcast(offset))  # one row
    prob = F.when((F.col("n") == 1) & first, F.lit(start if start is not None else 0.0)).when((F.col("n") == 2) & first, F.col("r") + F.col("offset")).otherwise(F.col("r"))
    back = F.when(F.col("n") == top, None).when(F.col("made"), -100000.0).when((F.col("n") == 1) & first, F.col("offset")).otherwise(0.0)
    return out.select("n", "words", prob.alias("logprob"), back.cast("double").alias("backoff"))
