"""SimHash near-duplicates: fingerprints, block join, Hamming check, groups.

Fingerprints are cut into five blocks. Two that differ in at most two bits agree on three
blocks at least, so they meet under one of the ten keys made of three blocks. Small buckets
compare their members directly. A bucket with many members is settled exactly without pairs:
two fingerprints differ in at most two bits if and only if some value lies within one bit of
both, so each member is filed under itself and its 64 one-bit neighbours, and a file, which
can't hold more than 65 different fingerprints, links all of its members.

For a stated similarity of shingle sets a wide fingerprint is used: its bits differ with a known
probability, so block length and number follow from the corpus and the recall that is wanted.
Pairs that share a block are held against the Hamming distance of the whole fingerprints, and what
that does not rule out is verified shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewright.llm.common import shielded, travels, written
from tidewright.operators.components import connected_components
from tidewright.session import cut

#: Bits of the five blocks; together 64.
BLOCKS = (13, 13, 13, 13, 12)
#: Largest bucket whose members are compared pair by pair.
DIRECT = 16
#: Shingles of a text that are hashed at a time.
SLICE = 100_000
#: Shingles of a text whose wide bits are summed at a time, and words the sum mixes per shingle.
WIDE_SLICE = 2_048
#: Members of a file that are compared with one another, or with as many others, in one cell.
CELL = 512
#: Groups that the rows of a frequent file or set are dealt to.
SALTS = 32
#: Most places of texts (three numbers each) that are sent to every executor.
SENT = 250_000
#: Standard deviations beyond the limit from which fingerprints alone rule a pair out.
MARGIN = 3.0

travels(__name__)


def _masks() -> list[int]:
    """The ten masks that keep three of the five blocks, as signed longs."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    blocks = [((1 << n) - 1) << at for n, at in zip(BLOCKS, starts, strict=True)]
    full = [a | b | c for a, b, c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text as a signed long; see near_duplicates."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, n = [b" ".join(words)], 1
        width = 1
    else:
        n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        part = words[at : min(at + SLICE, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        h = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    value = int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))
    return value - (1 << 64) if value >> 63 else value


@shielded(["text"], ["out"])
def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3, seed: int = 42) -> DataFrame:
    """docs with a long column `out`, the fingerprint of each whole text (null: as empty, 0)."""

    @F.arrow_udf(T.LongType())
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((fingerprint(t.as_py(), width, seed) for t in batch), pa.int64())

    return docs.withColumn(out, hashed(F.col(text).cast("string")))


def close_links(values: DataFrame, fp: str = "fp", direct: int = DIRECT) -> DataFrame:
    """Links (a, b), a < b, that connect exactly what differences of at most two bits connect.

    values: one row per distinct fingerprint in the long column fp. Every link is verified or
    holds by construction; in buckets of more than `direct` members a file's members are linked
    to its least one, which keeps the groups and not every pair. Nothing is capped."""
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(fp).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks()))))
    filed = values.select(F.col(fp).alias("fp"), keys.alias("key")).select("fp", "key.k", "key.bits")
    shared = cut(filed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(filed.join(shared, ["k", "bits"]).select("k", "bits", "n", "fp"))

    small = members.where(F.col("n") <= direct).groupBy("k", "bits").agg(F.collect_list("fp").alias("fps"))
    near = lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= 2)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("fps", near))).alias("p")).select("p.a", "p.b")

    crowd = members.where(F.col("n") > direct).select("fp").distinct()
    beside = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    files = crowd.select("fp", F.explode(beside).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = files.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def _labelled(docs: DataFrame, doc_id: str, text: str, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, fp), mark a hash of the text, and fingerprints (fp, least, first,
    component): the least id of each, its first row in order, and its component.

    Copies are counted together before anything is joined, so that a large group of them is one
    row; what is joined is read from written tables, so that Spark can split hot partitions."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut(fingerprints(rows, "text", "fp", width, seed).select("doc_id", F.xxhash64("text").alias("mark"), "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    values = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(order).alias("first")))
    groups = cut(connected_components(close_links(values.select("fp")), "a", "b"))
    values = values.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return rows, values


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; shingles are `width`
    words joined by a space, repeats included; a shorter text is one shingle; a text without
    words (null, empty, white space) has fingerprint 0 and is linked like any other. A bit is 1
    if it is set in over half of the shingles' XXH64. component_id is the least doc_id
    reachable over links of at most two differing bits; rows without a doc_id take part, and a
    component of such rows only has a null id. Repeated ids and rows keep a row each; an empty
    table gives an empty one; columns other than these two are ignored.
    """
    rows, values = _labelled(docs, doc_id, text, width, seed)
    named = cut(values.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = cut(values.join(named, "component").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def plan_blocks(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a block, number of blocks) for n texts.

    A bit of two sets with this Jaccard similarity differs with probability angle / pi. Blocks
    have two bits more than n needs, so that texts without likeness meet under a block about
    once in four files, at any n; there are as many as `recall` takes."""
    bits = min(30, max(12, math.ceil(math.log2(max(2, n))) + 2))
    same = (1 - _differs(similarity)) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _differs(similarity: float) -> float:
    """Probability that a bit differs, for sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_set(text: str | None, width: int, seed: int):
    """Sorted distinct XXH64 of the shingles: width words, or the whole of a shorter text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles)))


def wide_fingerprint(shingles, bits: int, blocks: int) -> list[int]:
    """SimHash of bits * blocks bits over a shingle set, as one int a block. Where as many
    shingles have a bit as have not, the first decides: small sets would share zeros else."""
    import numpy as np

    n, words = len(shingles), -(-bits * blocks // 64)
    ones = np.zeros(64 * words, np.int64)
    salts = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    tied = np.zeros(64 * words, bool)
    for at in range(0, n, WIDE_SLICE):
        h = shingles[at : at + WIDE_SLICE, None] ^ salts
        # the finishing rounds of splitmix64 (fixed values)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        set_bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        tied = tied if at else set_bits[0].astype(bool)
        ones += set_bits.sum(axis=0, dtype=np.int32)
    table = ((2 * ones > n) | ((2 * ones == n) & tied))[: bits * blocks].reshape(blocks, bits)
    return (table @ (1 << np.arange(bits))).tolist()


def _wide(rows: DataFrame, text: str, out: str, width: int, seed: int, bits: int, blocks: int) -> DataFrame:
    """rows with a struct `out`: same (hash of the shingle set), n (its size), fp."""
    kind = T.StructType([T.StructField("same", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(kind)
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for batch in batches:
            sets = [shingle_set(t.as_py(), width, seed) for t in batch]
            same = (int.from_bytes(xxhash.xxh64_digest(s.astype("<u8").tobytes(), seed), "little", signed=True) for s in sets)
            fps = [wide_fingerprint(s, bits, blocks) for s in sets]
            yield pa.StructArray.from_arrays([pa.array(same, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps, pa.list_(pa.int32()))], ["same", "n", "fp"])

    return rows.withColumn(out, hashed(F.col(text).cast("string")))


def _salted(rows: DataFrame, *by: str) -> DataFrame:
    """rows with a salt, so that a key's rows are dealt to SALTS groups."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))


def _beside(rows: DataFrame, key: str, other: str, table: DataFrame) -> DataFrame:
    """rows joined to a table of one row per `key`; a frequent key's rows are dealt out by `other`,
    and the table's row goes once to each of these groups."""
    salted = _salted(rows, other)
    asked = salted.select(key, "salt").distinct().join(table, key)
    return salted.join(asked, [key, "salt"]).drop("salt")


def similar_links(values: DataFrame, texts: tuple[DataFrame, DataFrame], similarity: float, bits: int, blocks: int, width: int, seed: int, cell: int = CELL) -> DataFrame:
    """Links (a, b) between shingle sets that share a block and are similar enough, as many as it
    takes to connect what such links connect.

    values: one row per set, (same, n, fp); texts: (doc_id, text), and where a text of each set
    is, (same, _id, _mark), _mark the text's hash. The members of a block's file are first
    compared with its lead, the one that shares blocks with most other sets: in a crowd of copies
    that is the text they were made from. Then members that nothing has linked so far are all
    compared, whatever the size of their file: it is cut into cells of bounded size. A pair is dropped by
    fingerprints only where they lie MARGIN standard deviations beyond the limit; all others
    are compared shingle by shingle, and only that makes a link."""
    keys = F.transform("fp", lambda x, i: i.cast("long") * (1 << 31) + x)
    filed = _salted(values.where("n > 0").select("same", F.explode(keys).alias("key")), "same")
    sizes = filed.groupBy("key", "salt").agg(F.count("*").alias("members"))
    sizes = sizes.withColumn("members", F.sum("members").over(Window.partitionBy("key"))).where("members > 1")
    filed = written(filed.join(sizes, ["key", "salt"]))
    known = filed.groupBy("same").agg(F.sum("members").alias("known"))
    heads = filed.join(known, "same").groupBy("key", "salt").agg(F.max(F.struct("known", "same")).alias("lead"))
    heads = heads.select("key", "salt", F.max("lead").over(Window.partitionBy("key"))["same"].alias("lead"))
    stars = filed.join(heads, ["key", "salt"]).where("same <> lead").select(F.col("lead").alias("a"), F.col("same").alias("b")).distinct()
    limits = _Limits(similarity, bits * blocks)
    first = written(_verified(_near(stars, values, limits), texts, similarity, width, seed))

    groups = written(connected_components(first, "a", "b")).withColumnRenamed("node", "same")
    rest = filed.where("members > 2").join(groups, "same", "left").withColumn("label", F.coalesce("component", "same")).select("key", "salt", "same", "label", "members")
    ends = rest.groupBy("key", "salt").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    over = Window.partitionBy("key")
    ends = ends.select("key", "salt", F.min("low").over(over).alias("low"), F.max("high").over(over).alias("high")).where("low < high")
    rest = rest.join(ends, ["key", "salt"]).select("key", "same", "label", "members")
    # a file's members are dealt to parts, and each pair of parts is a cell
    parts = F.ceil(F.col("members") / cell)
    rest = rest.withColumn("part", F.pmod(F.xxhash64("same"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rest = rest.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), (F.col("part") == F.col("other")).alias("own"), "part", "same", "label")
    rest = rest.join(values, "same").select("cell", "own", "part", "same", "label", "n", "fp")
    pairs = rest.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(limits), "a long, b long").distinct()
    second = written(_verified(pairs, texts, similarity, width, seed))
    return first.unionByName(second)


class _Limits:
    """How far fingerprints of `total` bits may lie apart for a similarity of sets."""

    def __init__(self, similarity: float, total: int) -> None:
        self.similarity, self.total = similarity, total
        p = _differs(similarity)
        self.margin = MARGIN * math.sqrt(total * p * (1 - p))

    def column(self, n_a: Column, n_b: Column, apart: Column) -> Column:
        """Whether two sets of these sizes may be similar."""
        a, b = n_a.cast("double"), n_b.cast("double")
        cosine = F.least(F.lit(1.0), self.similarity / (1 + self.similarity) * (a + b) / F.sqrt(a * b))
        return (F.least(a, b) >= self.similarity * F.greatest(a, b)) & (apart <= F.acos(cosine) / math.pi * self.total + self.margin)

    def numpy(self, n: int, others, apart):
        """The same for a set of n shingles and many others."""
        import numpy as np

        cosine = np.minimum(1.0, self.similarity / (1 + self.similarity) * (n + others) / np.sqrt(float(n) * others))
        return (np.minimum(n, others) >= self.similarity * np.maximum(n, others)) & (apart <= np.arccos(cosine) / math.pi * self.total + self.margin)


def _near(pairs: DataFrame, values: DataFrame, limits: _Limits) -> DataFrame:
    """Pairs (a, b) whose fingerprints allow for the similarity."""
    side = lambda x: values.select(F.col("same").alias(x), F.col("n").alias(f"n_{x}"), F.col("fp").alias(f"fp_{x}"))
    both = _beside(pairs.join(side("b"), "b"), "a", "b", side("a"))
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(limits.column(F.col("n_a"), F.col("n_b"), apart)).select("a", "b")


def _cells(limits: _Limits):
    """Pairs (a, b) of different labels in rows (cell, own, part, same, label, n, fp), sorted by
    cell, whose fingerprints allow for the similarity; a cell of two parts pairs one with the other."""

    def compared(cell: dict) -> tuple[list, list]:
        import numpy as np

        left, right = [], []
        for i in range(len(cell["same"]) - 1):
            rest = slice(i + 1, None)
            apart = np.bitwise_count(cell["fp"][rest] ^ cell["fp"][i]).sum(axis=1, dtype=np.int32)
            ok = limits.numpy(cell["n"][i], cell["n"][rest], apart) & (cell["label"][rest] != cell["label"][i])
            if not cell["own"][i]:
                ok &= cell["part"][rest] != cell["part"][i]
            found = np.flatnonzero(ok) + i + 1
            left += np.minimum(cell["same"][found], cell["same"][i]).tolist()
            right += np.maximum(cell["same"][found], cell["same"][i]).tolist()
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in _and_end(batches):
            if batch is None:
                now, starts = held, np.zeros(1, int)
            else:
                now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "own", "part", "same", "label", "n")}
                now["fp"] = batch.column("fp").flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint32)
                if held is not None:
                    now = {c: np.concatenate([held[c], v]) for c, v in now.items()}
                starts = np.flatnonzero(np.diff(now["cell"], prepend=now["cell"][:1] ^ 1))
            if now is None:
                return
            ends = [*starts[1:].tolist(), *([len(now["cell"])] if batch is None else [])]
            left, right = [], []
            for lo, hi in zip(starts.tolist(), ends, strict=False):
                a, b = compared({c: v[lo:hi] for c, v in now.items()})
                left += a
                right += b
            held = {c: v[starts[-1] :] for c, v in now.items()}
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _and_end(batches: Iterator) -> Iterator:
    """The batches that have rows, then None."""
    yield from (b for b in batches if b.num_rows)
    yield None


def _verified(pairs: DataFrame, texts: tuple[DataFrame, DataFrame], similarity: float, width: int, seed: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets are similar."""
    pairs = written(pairs)
    docs, at = texts
    named = written(at.join(pairs.select(F.col("a").alias("same")).unionByName(pairs.select(F.col("b").alias("same"))).distinct(), "same"))
    if named.count() <= SENT:
        named = F.broadcast(named)
    own = docs.join(named, docs["doc_id"].eqNullSafe(named["_id"]) & (F.xxhash64(docs["text"]) == named["_mark"]))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(t.as_py(), width, seed).view("<i8").tolist() for t in batch], pa.list_(pa.int64()))

    # rows that repeat id and text give a set more than once
    own = written(own.select("same", hashed(F.col("text").cast("string")).alias("s")).dropDuplicates(["same"]))
    side = lambda x, s: own.select(F.col("same").alias(x), F.col("s").alias(s))
    seen = _beside(pairs.join(side("b", "y"), "b"), "a", "b", side("a", "x"))
    seen = seen.withColumn("both", F.size(F.array_intersect("x", "y")))
    return seen.where(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


@shielded(["doc_id", "text"])
def first_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.9, seed: int = 42) -> DataFrame:
    """docs with one row of each group of similar texts; columns as they were.

    Texts are linked if the sets of their shingles (`width` words, A-Z lower-cased; a shorter
    text is one) have a Jaccard similarity of `similarity` or more; a pair at that limit is found
    with probability `recall`, closer ones nearly always, equal sets always; no pair that is less
    similar is linked. Groups are what links reach. The row with the least doc_id stays, nulls last; among rows that share it the
    one with the least text hash; of rows that repeat id and text, any one. Texts without words
    (null, empty) are one group; texts are read whole, however long; an empty table gives an
    empty one."""
    bits, blocks = plan_blocks(docs.count(), similarity, recall)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = _wide(plain, "text", "w", width, seed, bits, blocks)
    rows = written(rows.select("doc_id", F.xxhash64("text").alias("mark"), "w.same", "w.n", "w.fp"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    values = written(rows.groupBy("same").agg(F.min(order).alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    at = values.select("same", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    links = similar_links(values.select("same", "n", "fp"), (plain, at), similarity, bits, blocks, width, seed)
    groups = cut(connected_components(links, "a", "b"))
    values = values.select("same", "first").join(groups.withColumnRenamed("node", "same"), "same", "left").withColumn("component", F.coalesce("component", "same"))
    return _firsts(docs, doc_id, text, rows, values)


def _firsts(docs: DataFrame, doc_id: str, text: str, rows: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, one each."""
    stay = values.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    often = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("_n")).where("_n > 1")
    stay = stay.join(often, stay["_id"].eqNullSafe(often["doc_id"]) & (stay["_mark"] == often["mark"]), "left").select("_id", "_mark", F.coalesce("_n", F.lit(1)).alias("_n"))
    stay = cut(stay)
    kept = docs.join(stay, docs[doc_id].eqNullSafe(stay["_id"]) & (F.xxhash64(docs[text]) == stay["_mark"]))
    if stay.where("_n > 1").limit(1).count() == 0:
        return kept.select(*(docs[c] for c in docs.columns))
    own = [docs[c] for c in docs.columns]
    return kept.where("_n = 1").select(*own).unionByName(kept.where("_n > 1").dropDuplicates(["_id", "_mark"]).select(*own))


@shielded(["doc_id", "text"])
def first_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """docs with one row of each near-duplicate group; columns as they were.

    Groups as in near_duplicates: null, empty and wordless texts are one fingerprint; texts are
    read whole; an empty table gives an empty one. The row with the least doc_id stays, nulls
    last; among rows that share it the one with the least text hash; of rows that repeat id and
    text, any one."""
    rows, values = _labelled(docs, doc_id, text, width, seed)
    return _firsts(docs, doc_id, text, rows, values)
