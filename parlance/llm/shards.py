"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, store, table

#: Children of one node of the tree of partitions whose counts are drawn in sequence.
FAN_OUT = 256
#: A communication matrix is broadcast only while it has at most this many entries.
MATRIX_ENTRIES = 4_000_000
#: Bytes of text that a block of a shard holds about.
BLOCK_BYTES = 32 << 20
#: Bits of a position in ``monotonically_increasing_id``; those above number the partition.
AT_BITS = 33


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once for the row."""
    return F.transform(F.array(value), use)[0]


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys: 52 bits and a half."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hypergeometric(u: Column, population: Column, good: Column, draws: Column) -> Column:
    """Good ones among ``draws`` taken without replacement, by inversion of the distribution function at ``u``.

    The probabilities are taken from the mode outwards, each from the one before by their exact ratio, up to ten
    standard deviations and 30 on either side; what lies beyond is less than the rounding of a double. All
    arguments are whole numbers as doubles, so counts up to 2**53 are exact.
    """
    least, most = F.greatest(F.lit(0.0), draws + good - population), F.least(draws, good)
    mode = F.least(most, F.greatest(least, F.floor((draws + 1) * (good + 1) / (population + 2)).cast("double")))
    variance = F.when(population > 1, draws * (good / population) * (1 - good / population) * (population - draws) / (population - 1)).otherwise(0.0)
    reach = F.ceil(10 * F.sqrt(variance)) + 30

    def of(p: Column) -> Column:
        n, g, d, m = p["n"], p["g"], p["d"], p["mode"]
        up, down = F.least(p["most"] - m, p["reach"]), F.least(m - p["least"], p["reach"])
        # steps: 1, 2, .. upwards from the mode, then -1, -2, .. downwards; at step 0 the weight is 1
        steps = F.concat(
            F.filter(F.sequence(F.lit(0), up.cast("int")), lambda i: i > 0),
            F.filter(F.transform(F.sequence(F.lit(0), down.cast("int")), lambda i: -i), lambda i: i < 0),
        )

        def weight(before: Column, i: Column) -> Column:
            x = m + i
            rise = (g - x + 1) * (d - x + 1) / (x * (n - g - d + x))
            fall = (x + 1) * (n - g - d + x + 1) / ((g - x) * (d - x))
            return F.when(i > 0, F.when(i == 1, F.lit(1.0)).otherwise(before) * rise).otherwise(F.when(i == -1, F.lit(1.0)).otherwise(before) * fall)

        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))
        total = F.aggregate(steps, first, lambda s, i: let(weight(s["w"], i), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))), lambda s: s["sum"])
        # the last step at which the sum so far is still below u times the total, and then the next one
        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), F.lit(0).alias("at"), p["u"].alias("goal"))

        def walk(s: Column, i: Column) -> Column:
            return let(weight(s["w"], i), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), F.when(s["sum"] < s["goal"], i).otherwise(s["at"]).alias("at"), s["goal"].alias("goal")))

        return let(total, lambda t: F.aggregate(steps, start.withField("goal", p["u"] * t), walk, lambda s: m + s["at"]))

    names = dict(u=u, n=population, g=good, d=draws, least=least, most=most, mode=mode, reach=reach)
    return let(F.struct(*[v.cast("double").alias(k) for k, v in names.items()]), of)


def multivariate(draws: Column, left: Column, *keys: Column) -> Column:
    """How many of ``draws`` rows go to each shard, whose free places are ``left`` (doubles): an array of doubles."""
    start = F.struct(
        draws.alias("draws"), F.aggregate(left, F.lit(0.0), lambda a, x: a + x).alias("places"), F.array().cast("array<double>").alias("out")
    )

    def shard(s: Column, k: Column) -> Column:
        free = left[k]
        x = hypergeometric(uniform(*keys, k), s["places"], free, s["draws"])
        return let(x, lambda x: F.struct((s["draws"] - x).alias("draws"), (s["places"] - free).alias("places"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), start, shard, lambda s: s["out"])


def chain(children: Column, places: Column, *keys: Column) -> Column:
    """Counts of each child (a struct of node and n) by shard, drawn one child after the other: structs of node and counts."""
    start = F.struct(places.alias("left"), F.array().cast("array<struct<node:long,counts:array<double>>>").alias("out"))

    def child(s: Column, c: Column) -> Column:
        got = multivariate(c["n"].cast("double"), s["left"], *keys, c["node"])
        return let(
            got,
            lambda got: F.struct(
                F.zip_with(s["left"], got, lambda a, b: a - b).alias("left"), F.concat(s["out"], F.array(F.struct(c["node"].alias("node"), got.alias("counts")))).alias("out")
            ),
        )

    return F.aggregate(children, start, child, lambda s: s["out"])


def communication_matrix(parts: DataFrame, shards: int, seed: int, fan_out: int = FAN_OUT) -> DataFrame:
    """Rows that each part sends to each shard: part, counts (array of long), for a uniform shuffle of all rows.

    ``parts`` is a table of part (long) and n. The counts follow the distribution that the shuffle has: a part's
    row of the matrix is multivariate hypergeometric in the places that the shards have left. Parts are the
    leaves of a tree with ``fan_out`` children a node; a level's nodes are drawn side by side, a node's children
    in sequence, so neither work nor memory of a task grows with the number of parts. Row sums are the parts'
    sizes; column sums are the shards' sizes, at most one apart.
    """
    total = int(parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    highest = parts.agg(F.max("part")).first()[0] or 0
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    levels = [parts.select(F.col("part").cast("long").alias("node"), F.col("n").cast("long").alias("n"))]
    while highest > 0:
        highest //= fan_out
        levels.append(levels[-1].groupBy(F.expr(f"node div {fan_out}").alias("node")).agg(F.sum("n").alias("n")))
    drawn = levels[-1].select("node", F.lit(sizes).cast("array<double>").alias("counts"))  # one node holds all
    for level in range(len(levels) - 2, -1, -1):
        below = levels[level].groupBy(F.expr(f"node div {fan_out}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("children"))  # fan_out at most
        both = below.join(drawn.withColumnRenamed("node", "up"), "up")
        drawn = store(both.select(F.explode(chain(F.col("children"), F.col("counts"), F.lit(seed), F.lit(level))).alias("c")).select("c.*"), "matrix")
    return drawn.select(F.col("node").alias("part"), F.col("counts").cast("array<long>").alias("counts"))


def shuffle_to_shards(docs: DataFrame, shards: int = 8, *, seed: int = 42, block_bytes: int = BLOCK_BYTES, fan_out: int = FAN_OUT, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in a uniformly random order, dealt to shards whose row counts are at most one apart.

    Each task permutes its rows and writes them with their places. How many rows a part sends to each shard is
    drawn from the exact distribution (:func:`communication_matrix`); the first of its permuted rows go to shard
    0, the next to shard 1, and so on. The exchange deals rows to blocks of shards by a second random key, and
    each block is sorted by that key: the second permutation. Block sizes are counted without the texts, and their
    running sums make the place in the shard, so rows are shuffled once and no task holds a shard.

    Returns the columns of ``docs``, ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard); where
    ``docs`` has such a column already, the new one's name gets an underscore. The order depends on the seed and
    on how the rows lie in partitions, not on what they hold: nulls in any column, empty and very long texts,
    ties, repeated rows and hot sources are rows like others. Fewer rows than shards leave shards empty; an
    empty table gives no rows.
    """
    spark, columns = docs.sparkSession, docs.columns
    names = {k: fresh(columns, k) for k in ("shard", "slot", "_at", "_part", "_pos", "_key", "_block", "_size", "_start")}
    at, part, pos, key, block, size, start = (names[k] for k in ("_at", "_part", "_pos", "_key", "_block", "_size", "_start"))
    shard, slot = names["shard"], names["slot"]

    text = F.col(f"`{text_col}`") if text_col in columns else F.lit("")
    local = docs.withColumn(at, F.monotonically_increasing_id()).sortWithinPartitions(F.xxhash64(F.lit(seed), F.col(at)), at).drop(at)
    local = local.withColumn(at, F.monotonically_increasing_id())
    rows = store(
        local.select(
            *[F.col(f"`{c}`") for c in columns], F.shiftright(at, AT_BITS).alias(part), F.col(at).bitwiseAND(F.lit((1 << AT_BITS) - 1)).alias(pos),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(size),
        ),
        "rows",
    )

    parts = store(rows.groupBy(part).agg(F.count("*").alias("n"), F.sum(size).alias("size")).withColumnRenamed(part, "part"), "parts")
    seen = parts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    matrix = store(communication_matrix(parts, shards, seed, fan_out).withColumnRenamed("part", part), "matrix")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = matrix.select(part, ends.alias("_ends"))
    wanted = F.broadcast(matrix) if seen[0] * shards <= MATRIX_ENTRIES else matrix.hint("merge")

    # enough blocks for even tasks, and for blocks of bounded size
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-8 * tasks // shards), -(-int(seen[1]) // (shards * block_bytes)))
    second = F.xxhash64(F.lit(seed + 1), F.col(part), F.col(pos))
    dealt = (
        rows.join(wanted, part)
        .withColumn(shard, F.size(F.filter("_ends", lambda e: e <= F.col(pos))))
        .withColumn(key, second)
        .withColumn(block, F.floor((F.shiftrightunsigned(key, 32).cast("double")) * blocks / float(1 << 32)).cast("int"))
    )
    counted = dealt.groupBy(shard, block).agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy(block)  # one row a block
    offsets = store(counted.select(shard, block, (F.sum("n").over(before) - F.col("n")).alias(start)), "offsets")
    side = F.broadcast(offsets) if offsets.count() <= MATRIX_ENTRIES // 8 else offsets.hint("merge")
    order = Window.partitionBy(shard, block).orderBy(F.shiftrightunsigned(key, 0), part, pos)
    keep = [*[F.col(f"`{c}`") for c in columns], F.col(part), F.col(pos), F.col(shard), F.col(block), F.col(key)]
    placed = dealt.select(*keep).withColumn(slot, F.row_number().over(order).cast("long") - 1).join(side, [shard, block])
    return placed.select(*[F.col(f"`{c}`") for c in columns], F.col(shard), (F.col(slot) + F.col(start)).alias(slot))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> DataFrame:
    """Write the shuffled rows under ``path``, a folder for each shard, and return a scan of them."""
    out = shuffle_to_shards(docs, shards, **options)
    out.write.partitionBy(out.columns[-2]).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op11_shards(spark, sf_dir):
    """Shards 0 to 7 of whole documents, and what is asked for of each: the size and checksum of the text that was moved."""
    out = shuffle_to_shards(table(spark, sf_dir, "documents"), 8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
