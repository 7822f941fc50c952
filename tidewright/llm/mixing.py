"""Mixing sources to target weights, in DataFrame operations only.

A source's documents, in a pseudorandom order, make one stream of words that is cut into blocks
of fixed length. Each output shard draws how many blocks it takes from each source: the counts
are multinomial, given that each source's counts add up to its target, and are drawn by halving
the shards again and again. A shard's slots of a source follow from its count; a source's slots
run through a pseudorandom permutation of its block indices, again and again, each time another
one; so no block is taken more than once more than any other, and blocks are joined by index.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import SPACES, n_words
from tidewright.session import cut

#: Words of a block.
BLOCK = 128
#: Most blocks that an output shard holds on average; the number of shards is a power of two.
SHARD_BLOCKS = 1024
#: Slots that are halved by one random bit each; more are halved by a normal draw.
BITS = 16_384
#: About so many documents of a source are put in order by one task.
BUCKET = 8192
#: Multipliers of the index permutations: the first primes above a million (fixed values).
PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121, 1000133, 1000151, 1000159, 1000171, 1000183, 1000187, 1000193, 1000199)
#: A Lehmer generator's modulus and multiplier (fixed values); it puts documents in order.
MODULUS, MULTIPLIER = 2147483647, 48271


def _stir(x: Column) -> Column:
    """A pseudorandom number below MODULUS for a long; null counts as 0."""
    return F.pmod(F.pmod(F.coalesce(x, F.lit(0)).cast("long"), F.lit(MODULUS)) * MULTIPLIER, F.lit(MODULUS))


def _number(doc_id: str, kind: T.DataType) -> Column:
    """An id as a long that orders documents: integers as they are, others by their hash."""
    return F.col(doc_id).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(doc_id).cast("string"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size, n_rows) with rank, weight, target.

    Sources ranked by code point, null last, weigh as `weights` repeats. Targets share `share`
    times the sum of all sizes by weight; none is above `most` times its source's size, and what
    is over goes to the others by weight. In order of size by weight, those that stop come
    first, so one running sum settles it. One row per source is all that meets in a task."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everywhere = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everywhere))
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).drop("cap", "level")


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, weights, share: float, most: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, size, rank, start) and sources (source, ..., n_blocks, n_slots)."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), _number(doc_id, docs.schema[doc_id].dataType).alias("number"), F.xxhash64(F.col(text)).alias("mark"), F.col(source).alias("source"), n_words(docs[text]).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = source_targets(sizes, weights, share, most)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.round(F.col("target") / (F.col("source_size") / F.col("n_blocks"))).cast("long")
    sources = cut(sources.withColumn("n_slots", F.when(F.col("n_blocks") == 0, F.lit(0).cast("long")).otherwise(F.least(slots, F.floor(most * F.col("n_blocks")).cast("long")))))

    n_buckets = F.ceil(F.col("n_rows") / BUCKET).cast("long")
    facts = sources.select(F.col("source").alias("_source"), "rank", n_buckets.alias("n_buckets"))
    placed = rows.join(facts, rows["source"].eqNullSafe(facts["_source"])).drop("_source", "source").withColumn("stir", _stir(F.col("number"))).withColumn("bucket", F.pmod("stir", "n_buckets"))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("stir", F.col("doc_id").asc_nulls_first(), "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["rank", "bucket"])
    return placed.select("doc_id", "mark", "size", "rank", (F.col("offset") + F.col("before")).alias("start")), sources


def draw_counts(sources: DataFrame, seed: int = 7, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(rank, n_blocks, shard, first, n): how many slots each shard draws from each source, and
    the first of them; rows without any are left out.

    All shards start as one that has all slots. Halving a group of shards, each of its slots
    goes left with probability one half, so the counts of single shards are multinomial. One
    random bit a slot decides, or, beyond BITS slots, a normal draw of the same mean and spread.
    Half-way down the groups are dealt out to all tasks."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    levels = max(0, (-(-total // shard_blocks) - 1).bit_length())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sources.where("n_slots > 0").select("rank", "n_blocks", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("n_slots").alias("n"))

    def roll(level: int, *more: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(level), "rank", "shard", *more)

    def left(level: int) -> Column:
        rest = (F.col("n") % 64).cast("int")
        word = lambda i: F.when(i < (F.col("n") / 64).cast("int"), roll(level, i)).when(rest > 0, F.call_function("shiftrightunsigned", roll(level, i), 64 - rest)).otherwise(F.lit(0).cast("long"))
        full = F.transform(F.sequence(F.lit(0), (F.col("n") / 64).cast("int")), lambda i: F.bit_count(word(i)))
        uniform = lambda k: (F.shiftrightunsigned(roll(level, F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)
        normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
        near = F.round(F.col("n") / 2 + F.sqrt(F.col("n").cast("double")) / 2 * normal).cast("long")
        bits = F.aggregate(full, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.when(F.col("n") <= BITS, bits).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), near)))

    for level in range(levels):
        if level == levels // 2:
            rows = rows.repartition(parts, "rank", "shard")
        half = 1 << (levels - 1 - level)
        # the one-element array binds the draw, so that it is made once
        halves = F.transform(F.array(left(level)), lambda k: F.array(F.struct(F.col("shard").alias("shard"), F.col("first").alias("first"), k.alias("n")), F.struct((F.col("shard") + half).alias("shard"), (F.col("first") + k).alias("first"), (F.col("n") - k).alias("n"))))[0]
        rows = rows.select("rank", "n_blocks", F.explode(halves).alias("h")).select("rank", "n_blocks", "h.shard", "h.first", "h.n").where("n > 0")
    return rows


def draw_slots(sources: DataFrame, seed: int = 7, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, rank, slot, block): the slots that each shard draws, and the block index that the
    source's permutation gives for each."""
    rows = draw_counts(sources, seed, shard_blocks).withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    lap = F.floor(F.col("slot") / F.col("n_blocks")).cast("long")
    draw = _stir(F.lit(seed) + F.col("rank") * 7919 + lap * 104729)
    prime = F.filter(F.array(*(F.lit(p).cast("long") for p in PRIMES)), lambda p: F.pmod(F.col("n_blocks"), p) != 0)
    rows = rows.withColumn("draw", draw).withColumn("primes", prime)
    step = F.element_at("primes", (F.pmod("draw", F.size("primes")) + 1).cast("int"))
    index = F.pmod(step * F.pmod("slot", "n_blocks") + F.col("draw"), F.col("n_blocks"))
    return rows.select("shard", "rank", "slot", index.alias("block"))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """placed with one row per block that a document has words in: block, first and last + 1 of
    those words within the document."""
    end = F.col("start") + F.col("size")
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((end - 1) / block).cast("long"))))
    return spread.withColumn("first", F.greatest(F.col("start"), F.col("block") * block) - F.col("start")).withColumn("stop", F.least(end, (F.col("block") + 1) * block) - F.col("start"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken; mark is a
    hash of the text.

    size counts the words `[^\\x20\\x09-\\x0D]+` (null text: 0); taken counts them as often as
    the mix takes them. A block is taken at most `most` times, so no document exceeds that.
    Ids are of any type. Null sources are one source; null ids are ordered first; null and empty
    texts have no words; repeated rows keep a row each; an empty table gives an empty one; other
    columns are ignored. Reruns agree: nothing depends on how rows are partitioned.
    """
    placed, sources = _plan(docs, doc_id, text, source, weights, share, most, block)
    placed = cut(placed)
    # unfolded slots look as small as the sources to the optimizer; they must not be broadcast
    times = draw_slots(sources, seed).groupBy("rank", "block").agg(F.count("*").alias("times")).hint("merge")
    taken = _pieces(placed, block).join(times, ["rank", "block"], "left").groupBy("doc_id", "mark", "size", "rank", "start").agg(F.sum((F.col("stop") - F.col("first")) * F.coalesce("times", F.lit(0))).alias("taken"))
    taken = taken.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return taken.join(sources.select("rank", "source_size", "target"), "rank").select("doc_id", "mark", "size", "source_size", "target", "taken")


def mix_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mix itself: (shard, source, slot, block, doc_ids, text), a row per slot drawn.

    text holds the block's words, one space between them; doc_ids the documents they are from,
    in order. All blocks of a source but its last have `block` words. Cases as in mix_documents.
    """
    placed, sources = _plan(docs, doc_id, text, source, weights, share, most, block)
    placed = cut(placed.where("size > 0"))
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).withColumn("_mark", F.xxhash64("_text"))
    if placed.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(["_id", "_mark"])
    rows = placed.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    end = F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((end - 1) / block).cast("long"))

    def pieces(tokens: Column) -> Column:
        def piece(b: Column) -> Column:
            first, stop = F.greatest(F.col("start"), b * block) - F.col("start"), F.least(end, (b + 1) * block) - F.col("start")
            return F.struct(b.alias("block"), F.array_join(F.slice(tokens, (first + 1).cast("int"), (stop - first).cast("int")), " ").alias("piece"))

        return F.transform(blocks, piece)

    # the one-element array binds the words, so that a text is split once
    words = F.split(F.btrim("_text", F.lit(SPACES)), "[ \\t-\\r]+")
    found = rows.select("rank", "start", "doc_id", F.explode(F.transform(F.array(words), pieces)[0]).alias("p")).select("rank", "p.block", F.struct("start", "doc_id", "p.piece").alias("p"))
    packed = found.groupBy("rank", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    packed = packed.select("rank", "block", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.piece", " ").alias("text"))
    # a block's takers are gathered, at most `most` of them, so that its text moves once and is
    # copied last; the hashed side is numbers only
    takers = draw_slots(sources, seed).groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("slot", "shard"))).alias("takers"))
    mixed = packed.join(takers.hint("shuffle_hash"), ["rank", "block"]).join(sources.select("rank", "source"), "rank")
    return mixed.select("source", "block", "doc_ids", "text", F.explode("takers").alias("t")).select("t.shard", "source", "t.slot", "block", "doc_ids", "text")
