"""Mixing sources to target weights, block by block.

The words of a source, its documents in a pseudorandom order, are packed into blocks of a fixed
length. Output shards have a fixed number of slots; for each shard the counts of all sources are one
multinomial draw. Shards come in waves, and a wave draws by what its sources still need, so chance
misses of a wave are made up for by the next ones and only those of the last few slots stay. The slots of a source are numbered over all shards, a pseudorandom
permutation of the source's blocks maps the number to a block, and slots join blocks by that index. A
second pass over a source goes by another permutation, and no source has more than three.

The order of documents comes from sums in two levels: hash buckets within a source, then the
documents of a bucket, so no task holds a source. Rows that are equal in all columns read are one
row with a count until they are numbered, and the number salts their bucket. Everything random is a
hash of contents and indices, so reruns agree.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.lineage import settle
from .joins import spread_join

BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
RANGE_SLOTS = 2048
TASK_SLOTS = 131_072
BUCKET_DOCS = 4096
MOST_PASSES = 3
MOST_SOURCES = 100_000
LAST_SLOTS = 8
TAIL_SLOTS = 16_384
HOT_ROWS = 4096
WEIGHTS = (5, 2, 1)
ROUNDS = 24
SEED = 9

_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Words wanted of each source: shares by repeating weights, none above three times its size.

    Sources go by code point, null last. What a source cannot give is shared again by weight among
    those below their limit, until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    limit = {s: float(MOST_PASSES * n) for s, n in sizes.items()}
    total = float(sum(sizes.values()))
    fixed: dict[str | None, float] = {}
    while len(fixed) < len(order):
        free = [s for s in order if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > limit[s]]
        if not over:
            return fixed | {s: left * weight[s] / share for s in free}
        fixed |= {s: limit[s] for s in over}
    return fixed


def permuted(index: Column, size: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0 to size - 1 under the keys, by swap-or-not rounds.

    Each round pairs an index with its mirror image about a keyed point and swaps the two or not by
    a hash that both compute alike; that is a bijection for any size.
    """

    def swap(at: Column, turn: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*keys, turn), size) - at, size)
        bit = F.xxhash64(*keys, turn, F.greatest(at, mirror)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def row_key(docs: DataFrame, columns: list[str]) -> Column:
    """128 bits of the columns of a row."""
    whole = F.to_json(F.struct(*[docs[c] for c in columns]), {"ignoreNullFields": "false"})
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(SEED), whole).alias("b"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, key, copy, row, size)`` of every row of ``docs``.

    ``key`` stands for id, source and text, and rows that share it are numbered by ``copy`` from 0;
    ``row`` stands for all columns. Equal rows are counted before the shuffle and only then drawn
    out again, so no task gathers them.
    """
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        row_key(docs, ["doc_id", "source", "text"]).alias("key"),
        row_key(docs, docs.columns).alias("row"),
        size.alias("size"),
    )
    counted = rows.groupBy("key", "row", "doc_id", "source", "size").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    counted = counted.select("doc_id", "source", "key", "row", "size", "rows", first)
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("rows") - 1)).alias("copy")
    return counted.select("doc_id", "source", "key", each, "row", "size")


def _sources(sized: DataFrame) -> DataFrame:
    """One row per source, numbered: the recipe of the mix, which is held by the driver up to a limit."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    found = found.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    target = targets({r["source"]: r["size"] for r in found})
    fields = [
        T.StructField("source", sized.schema["source"].dataType),
        T.StructField("number", T.LongType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("buckets", T.LongType()),
    ]
    rows = [
        (r["source"], k, r["size"], target[r["source"]], -(-r["docs"] // BUCKET_DOCS))
        for k, r in enumerate(sorted(found, key=lambda r: (r["source"] is None, r["source"] or "")))
    ]
    return spark.createDataFrame(rows, T.StructType(fields))


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with words, and the place in its source where its words begin.

    A bucket's words make blocks of their own, the last one shorter; blocks are numbered through
    the buckets of a source.
    """
    keep = ["number", "doc_id", "key", "copy", "row", "size", "source_size", "target"]
    rows = spread_join(sized.filter(F.col("size") > 0), sources, "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "copy", F.lit(SEED)), F.col("buckets")))
    totals = rows.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    blocks = F.ceil(F.col("words") / BLOCK_WORDS).cast("long")
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("number").alias("_number"),
        F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum(blocks).over(earlier), F.lit(0)).alias("first_block"),
    )
    before = (
        Window.partitionBy("number", "bucket")
        .orderBy(F.xxhash64("key", "copy"), "key", "copy")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    same = (F.col("number") == F.col("_number")) & (F.col("bucket") == F.col("_bucket"))
    start = F.col("first_block") * BLOCK_WORDS + F.col("at")
    return within.join(bases, same).select(*keep, start.alias("start"))


def _shares(needs: dict[int, int]) -> list[tuple[int, float, float]]:
    """``(number, low, high)`` of sources that need something: where a draw from 0 to 1 falls."""
    total, rows, low = sum(needs.values()), [], 0.0
    for number, need in sorted(needs.items()):
        if need > 0:
            rows.append((number, low, low + need / total))
            low = rows[-1][2]
    # The last share ends where the draws do, whatever rounding made of the sum.
    rows[-1] = (*rows[-1][:2], 2.0)
    return rows


def _draws(spark: SparkSession, first: int, slots: int) -> DataFrame:
    """``(id, draw)`` of the slots from ``first`` on: each draws by a hash of its number."""
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(first, first + slots, 1, max(1, -(-slots // TASK_SLOTS))).select("id", draw.alias("draw"))


def drawn_counts(spark: SparkSession, waves: list[tuple[int, int, list]]) -> DataFrame:
    """``(shard, number, n)``: per shard the draws of its slots, from waves ``(first, slots, shares)``.

    Waves follow one another; shards are dealt slots in order and may lie in two waves.
    """
    bins = 1024
    rows = [(k, *share) for k, (_, _, shares) in enumerate(waves) for share in shares]
    edges = spark.createDataFrame(rows, "of int, number long, low double, high double")
    # A draw meets only the shares that reach into its bin.
    reach = F.sequence(F.floor(F.col("low") * bins), F.least(F.floor(F.col("high") * bins), F.lit(bins - 1)))
    edges = edges.select("of", "number", "low", "high", F.explode(reach).alias("reached"))
    first, end = waves[0][0], waves[-1][0] + waves[-1][1]
    wave = F.lit(len(waves) - 1)
    for k, (low, slots, _) in reversed(list(enumerate(waves))):
        wave = F.when(F.col("id") < low + slots, k).otherwise(wave)
    drawn = _draws(spark, first, end - first)
    shard, at = F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.floor(F.col("draw") * bins).alias("bin")
    drawn = drawn.select(shard, wave.cast("int").alias("wave"), "draw", at)
    hit = (F.col("wave") == F.col("of")) & (F.col("bin") == F.col("reached"))
    hit = hit & (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high"))
    return drawn.join(edges, hit).groupBy("shard", "number").agg(F.count("*").alias("n"))


def _waves(recipe: list[tuple[int, int, int]], spark: SparkSession) -> list[tuple[int, int, list]]:
    """Waves ``(first, slots, shares)`` that bring sources to what they need.

    A wave's sums per source come back from the cluster; the last ``TAIL_SLOTS`` slots' draws do so
    at once, and their waves are counted here.
    """
    needs = {number: wanted for number, _, wanted in recipe}
    first, left, waves, tail = 0, sum(needs.values()), [], None
    end = left
    while left and any(needs.values()):
        # What is left over must be well above the chance miss of the source that needs least.
        scarce = min(need for need in needs.values() if need)
        rest = left * min(1 / 2, max(1 / 64, 4 / math.sqrt(scarce)))
        slots = left if left <= LAST_SLOTS else left - int(rest)
        wave = (first, slots, _shares(needs))
        waves.append(wave)
        if left <= TAIL_SLOTS:
            if tail is None:
                tail = np.array([r["draw"] for r in _draws(spark, first, left).orderBy("id").collect()])
            draws = tail[len(tail) - (end - first) :][:slots]
            place = np.searchsorted([low for _, low, _ in wave[2]], draws, side="right") - 1
            sums = dict(zip(*np.unique([wave[2][k][0] for k in place], return_counts=True), strict=True))
        else:
            rows = drawn_counts(spark, [wave]).groupBy("number").agg(F.sum("n").alias("n")).collect()
            sums = {r["number"]: r["n"] for r in rows}
        needs = {number: max(need - int(sums.get(number, 0)), 0) for number, need in needs.items()}
        first, left = first + slots, left - slots
    return waves


def _slots(recipe: list[tuple[int, int, int]], spark: SparkSession) -> DataFrame:
    """``(shard, number, block)`` of every slot of the mix, from ``(number, blocks, wanted)``."""
    waves = _waves(recipe, spark)
    if not waves:
        return spark.createDataFrame([], "shard long, number long, block long")
    counts = settle(drawn_counts(spark, waves))
    earlier = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranged = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # Ranges are cut and dealt out first: their rows are few, what becomes of them is the work.
    ends = F.col("first") + F.col("n")
    starts = F.explode(F.sequence(F.col("first"), ends - 1, F.lit(RANGE_SLOTS).cast("long")))
    cut = ranged.select("number", "shard", starts.alias("low"), ends.alias("end"))
    # One row per source, of which there are at most MOST_SOURCES; what the slots become is large.
    table = F.broadcast(spark.createDataFrame([r[:2] for r in recipe], "own long, blocks long"))
    cut = cut.join(table, F.col("number") == F.col("own")).drop("own")
    cut = cut.repartition(-(-(waves[-1][0] + waves[-1][1]) // TASK_SLOTS), "number", "low")
    high = F.least(F.col("low") + RANGE_SLOTS, F.col("end"))
    index = F.explode(F.sequence(F.col("low"), high - 1)).alias("index")
    each = cut.select("number", "shard", "blocks", index)
    # Beyond the third pass a source has nothing left to give.
    each = each.filter(F.col("index") < MOST_PASSES * F.col("blocks"))
    turn = F.floor(F.col("index") / F.col("blocks"))
    block = permuted(F.pmod("index", "blocks"), F.col("blocks"), F.col("number"), turn, F.lit(SEED))
    return each.select("shard", "number", block.alias("block"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of all ``docs(doc_id, text, source)`` as pieces; and the sizes and sources behind it.

    Pieces are ``number, doc_id, key, copy, row, size, start, block, words, uses``: how often the
    mix takes the words that a document has in a block. Sizes have every row; sources their target.
    """
    spark = docs.sparkSession
    sized = settle(word_counts(docs))
    sources = _sources(sized)
    placed = settle(_placed(sized, sources))
    end = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    counted = placed.groupBy("number").agg(
        (F.max(end) + 1).alias("blocks"), F.first("source_size").alias("words"), F.first("target").alias("target")
    )
    recipe = [
        (r["number"], r["blocks"], min(round(r["target"] * r["blocks"] / r["words"]), MOST_PASSES * r["blocks"]))
        for r in sorted(counted.collect(), key=lambda r: r["number"])
    ]
    uses = _slots(recipe, spark).groupBy("number", "block").agg(F.count("*").alias("uses"))
    uses = uses.select(F.col("number").alias("_number"), F.col("block").alias("_block"), "uses")
    first = F.floor(F.col("start") / BLOCK_WORDS)
    pieces = placed.select(
        "number", "doc_id", "key", "copy", "row", "size", "start", F.explode(F.sequence(first, end)).alias("block")
    )
    from_ = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    to = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    pieces = pieces.withColumn("words", to - from_)
    same = (F.col("number") == F.col("_number")) & (F.col("block") == F.col("_block"))
    # Both sides are large, however small the table of counts is that the uses are drawn out of.
    joined = pieces.join(uses.hint("merge"), same, "left").drop("_number", "_block")
    return joined.withColumn("uses", F.coalesce("uses", F.lit(0))), sized, sources


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row of ``docs(doc_id, text, source)``.

    A null or empty text has size 0 and nothing is taken of it; a null source is one of its own,
    the last. Repeated rows and null ids are documents like any other; which of several equal rows
    gives more words is not told apart. An empty table gives no rows. Other columns are not read.
    """
    pieces, sized, sources = mix(docs.select("doc_id", "text", "source"))
    taken = pieces.groupBy("number", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    facts = sources.select("number", "source_size", "target")
    some = spread_join(taken.drop("start"), facts, "number")
    none = spread_join(sized.filter(F.col("size") == 0), sources, "source")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(*columns).union(none.withColumn("taken", F.lit(0).cast("long")).select(*columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, as the mix takes them: up to three copies of a text or of parts of it.

    Copy c holds the words that are taken c times or more, in their order; n_chars is in step. Rows
    of which nothing is taken go; that holds for null texts and texts without a word. Each row is
    taken with its own columns, also where rows share a doc_id or have none; a null source is a
    source of its own. An empty table stays empty, very long texts are cut whole.
    """
    pieces, _, _ = mix(docs)
    part = F.struct("block", "words", "uses")
    rows = pieces.groupBy("number", "start", "row", "copy").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,words:bigint,uses:bigint>>").alias("out"))
    offsets = F.aggregate(
        "parts",
        first,
        lambda done, p: F.struct(
            (done["at"] + p["words"]).alias("at"),
            F.concat(done["out"], F.array(F.struct(done["at"].alias("at"), p["words"].alias("words"), p["uses"].alias("uses")))).alias("out"),
        ),
        lambda done: done["out"],
    )
    rows = settle(rows.select(F.col("row").alias("own"), "copy", offsets.alias("parts")))
    # Of equal rows one is read, for as many tasks as their number asks for.
    many = rows.groupBy("own").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("salts")).filter(F.col("salts") > 1)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(docs, docs.columns).alias("key"))
    whole = whole.groupBy("key").agg(F.first("row").alias("row"))
    salt = F.lit(0)
    if not many.isEmpty():
        rows = spread_join(rows, many, "own", "left")
        salt = F.pmod(F.xxhash64("copy"), F.coalesce("salts", F.lit(1))).cast("int")
        whole = spread_join(whole, many.withColumnRenamed("own", "key"), "key", "left")
        turns = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        whole = whole.select("key", "row", turns.alias("turn"))
    else:
        whole = whole.withColumn("turn", salt)
    rows = rows.select("own", "parts", salt.alias("salt"))
    taken = whole.join(rows, (F.col("key") == F.col("own")) & (F.col("turn") == F.col("salt")))
    taken = taken.select("row", "parts", F.explode(F.sequence(F.lit(1), F.lit(MOST_PASSES))).alias("copy"))
    taken = taken.filter(F.exists("parts", lambda p: p["uses"] >= F.col("copy")))
    tokens = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    taken = taken.withColumn(
        "tokens", F.when(F.exists("parts", lambda p: p["uses"] < F.col("copy")), tokens)
    )
    kept = F.filter("parts", lambda p: p["uses"] >= F.col("copy"))
    cut = F.array_join(
        F.transform(kept, lambda p: F.array_join(F.slice("tokens", (p["at"] + 1).cast("int"), p["words"].cast("int")), "")), ""
    )
    text = F.when(F.col("tokens").isNull(), F.col("row.text")).otherwise(F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", ""))
    done = taken.select("row", text.alias("cut"))
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
