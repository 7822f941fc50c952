"""Collocations: word sequences that occur together more often than their parts would.

Texts are split into pieces; identical pieces become one row with a multiplicity. Sequences of n
words are counted length by length, weighted by multiplicity: Spark deals them out by hash, and
duckdb adds up each hash bucket out of core, with a memory limit and a folder of its own to
spill to. A sequence can be frequent only if those of one word less in it are; these are known by a
bit filter of fixed size, which lets too many through but never too few, so counts stay exact.
Candidates then ask for the counts of their parts: requests are shuffled to where the counts
are, many requests for one part under several salts.
"""

from __future__ import annotations

import itertools
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import travels, written

#: Characters that end a piece.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: Bits of the filter of frequent sequences, as a power of two: 16 MB.
FILTER_BITS = 27
#: Bytes of pieces whose sequences are added up before they are shuffled.
BATCH_BYTES = 16_000_000
#: What duckdb may hold of a bucket before it spills.
DUCKDB_MEMORY = "300MB"
#: Groups that the requests for one part are dealt to.
SALTS = 16

PARTS = "lang string, gram string, w long"
COUNTS = "lang string, gram string, f long"

travels(__name__)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (lang, piece) of texts (lang, text), whole columns at a time."""
    import numpy as np
    import pyarrow.compute as pc

    # UTF-8 keeps bytes under 0x80 for ASCII, so that bytes can be exchanged one by one
    byte = np.arange(256, dtype=np.uint8)
    byte[ord("A") : ord("Z") + 1] += 32
    byte[[ord(c) for c in ENDS]] = ord("\n")
    byte[ord("\t")] = ord(" ")
    for table in _together(batches):
        texts = table["text"].combine_chunks()
        valid, offsets, data = texts.buffers()
        if data is None:
            continue
        changed = pa.py_buffer(byte[np.frombuffer(data, np.uint8)])
        texts = pa.Array.from_buffers(pa.string(), len(texts), [valid, offsets, changed], offset=texts.offset)
        lists = pc.split_pattern(texts, "\n")
        found = pa.table({"lang": table["lang"].combine_chunks().take(pc.list_parent_indices(lists)), "piece": pc.ascii_trim(lists.flatten(), " ")})
        found = found.filter(pc.greater(pc.binary_length(found["piece"]), 0))
        uneven = pc.match_substring(found["piece"], "  ")
        if pc.any(uneven).as_py():
            even = pc.replace_substring_regex(found["piece"].filter(uneven), " +", " ")
            found = found.set_column(1, "piece", pc.replace_with_mask(found["piece"].combine_chunks(), uneven.combine_chunks(), even.combine_chunks()))
        yield from found.to_batches()


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang", unknown: str = "und") -> DataFrame:
    """(lang, piece, w): distinct pieces with their words one space apart, and how often each occurs.

    A-Z are lower-cased, pieces end at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. A null text is
    empty, a null lang `unknown`; pieces without words go."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(unknown)).alias("lang"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(_split, "lang string, piece string").groupBy("lang", "piece").agg(F.count("*").alias("w"))


def _stirred(h):
    """The finishing rounds of splitmix64 (fixed values)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words:
    """Words of many pieces, one after another, and hashes of the sequences that start at each."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        self.codes, self.vocabulary = coded.indices.to_numpy(), coded.dictionary
        sizes = np.diff(ends)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.left = np.repeat(ends[1:], sizes) - np.arange(len(self.row), dtype=np.int32)  # words from here to the piece's end
        self.langs = langs.dictionary_encode()

    def hashes(self, n: int):
        """Hash of lang and the n words from each place on; of no use where fewer are left."""
        import numpy as np
        import xxhash

        tongue = np.array([xxhash.xxh64_intdigest(x.as_py(), 1) for x in self.langs.dictionary], np.uint64)
        word = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))[self.codes]
        h = _stirred(tongue[self.langs.indices.to_numpy()][self.row] ^ word)
        for k in range(1, n):
            h[: len(h) - k] = _stirred(h[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
        return h

    def pass_(self, n: int, known, bits: int):
        """Whether the n words from each place on pass the filter."""
        import numpy as np

        passes, slot = np.frombuffer(known.value, np.uint8), self.hashes(n) >> np.uint64(64 - bits)
        return (self.left >= n) & ((passes[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def added(self, at, n: int, weights) -> pa.Table:
        """(lang, gram, w): the different sequences of n words from the places `at` on."""
        import pyarrow.compute as pc

        words = {f"k{k}": self.codes[at + k] for k in range(n)}
        keys = pa.table({"lang": self.langs.indices.to_numpy()[self.row[at]], **words, "w": weights[self.row[at]]})
        keys = keys.group_by(["lang", *words]).aggregate([("w", "sum")]).combine_chunks()
        grams = pc.binary_join_element_wise(*(self.vocabulary.take(keys[k].combine_chunks()) for k in words), " ")
        return pa.table({"lang": self.langs.dictionary.take(keys["lang"].combine_chunks()), "gram": grams, "w": keys["w_sum"]})


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to BATCH_BYTES, and larger ones divided."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].nbytes
            if size >= BATCH_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sequences(n: int, known, bits: int):
    """Parts (lang, gram, w) of pieces (lang, piece, w): their sequences of n words, of n > 1
    those only whose first and last n - 1 words pass the filter."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for table in _together(batches):
            words = _Words(table["lang"].combine_chunks(), table["piece"].combine_chunks())
            if known is None:
                at = np.arange(len(words.row))
            else:
                ok = words.pass_(n - 1, known, bits)
                at = np.flatnonzero((words.left >= n) & ok & np.append(ok[1:], False))
            if len(at):
                yield from words.added(at, n, table["w"].to_numpy()).to_batches()

    return found


def _runs(n: int, known, bits: int):
    """Runs (lang, piece, w) of words in pieces all of whose sequences of n words pass the filter,
    if they are longer than n: no other place has a frequent sequence of more words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for table in _together(batches):
            langs = table["lang"].combine_chunks()
            words = _Words(langs, table["piece"].combine_chunks())
            ok = words.pass_(n, known, bits)
            # a piece's last places have fewer than n words left, so that runs end inside of it
            edge = np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = stop - start > 1
            start, size = start[long], stop[long] - start[long] + n - 1
            if len(start):
                ends = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.vocabulary.take(pa.array(words.codes[at])))
                row = pa.array(words.row[start])
                yield pa.RecordBatch.from_arrays([langs.take(row), pc.binary_join(lists, " "), table["w"].combine_chunks().take(row)], ["lang", "piece", "w"])

    return found


def _added(least: int, totals: bool, memory: str):
    """Counts (lang, gram, f) of a bucket's parts, least and more; with totals also each lang's
    sum, its gram null."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        folder = tempfile.mkdtemp()
        try:
            db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": folder, "preserve_insertion_order": False})
            db.register("parts", pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], batches)))
            db.execute("CREATE TEMP TABLE counts AS SELECT lang, gram, sum(w)::BIGINT AS f FROM parts GROUP BY lang, gram")
            sums = "UNION ALL SELECT lang, NULL, sum(f)::BIGINT FROM counts GROUP BY lang" if totals else ""
            yield from db.sql(f"SELECT lang, gram, f FROM counts WHERE f >= {least} {sums}").to_arrow_reader(50_000)
            db.close()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return counted


def _slots(n: int, bits: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for table in _together(batches):
            words = _Words(table["lang"].combine_chunks(), table["gram"].combine_chunks())
            slot = (words.hashes(n) >> np.uint64(64 - bits))[words.left == n]
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64))], ["slot"])

    return found


def _filter(counts: DataFrame, n: int, bits: int) -> bytes:
    """2 ** bits bits, set at the hashes of the sequences of n words; its size is fixed."""
    slots = counts.select("lang", "gram").mapInArrow(_slots(n, bits), "slot long")
    parts = slots.groupBy((F.shiftright("slot", 15)).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    out = bytearray(1 << (bits - 3))
    for row in parts.toLocalIterator():
        out[row["at"] << 12 : (row["at"] + 1) << 12] = row["bits"]
    return bytes(out)


def frequent_sequences(found: DataFrame, least: int, longest: int, bits: int = FILTER_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all word occurrences, and by length, from 1, the sequences (lang, gram, f)
    that occur `least` times or more in pieces (lang, piece, w)."""
    sc, known, levels, totals = found.sparkSession.sparkContext, None, [], None
    for n in range(1, longest + 1):
        parts = found.mapInArrow(_sequences(n, known, bits), PARTS)
        counts = written(parts.repartition("lang", "gram").mapInArrow(_added(least, n == 1, DUCKDB_MEMORY), COUNTS))
        if n == 1:
            totals = counts.where("gram IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
            counts = counts.where("gram IS NOT NULL")
        levels.append(counts)
        if n < longest:
            if known is not None:
                known.unpersist()
            known = sc.broadcast(_filter(counts, n, bits))
        if 1 < n < longest:
            runs = found.mapInArrow(_runs(n, known, bits), "lang string, piece string, w long")
            found = written(runs.groupBy("lang", "piece").agg(F.sum("w").alias("w")))
    return totals, levels


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """Each lang's best phrases: lang, rank, phrase, a, l, r, n, score.

    n counts a lang's words, a, l and r the occurrences, within pieces, of a phrase of 2 to
    `longest` words that occurs `least` times or more and of its two parts at the cut whose score,
    floor(1000 * a * n / (l * r)), is lowest (of equals the first cut). A phrase that lies in a longer one
    which occurs as often goes. Order: score, a, both from the highest, then phrase by UTF-8
    bytes. Null texts are empty, a null lang is `und`; pieces are read whole, however long;
    repeated rows count each; no words, no rows; other columns are ignored. Products are exact
    up to 38 digits; beyond, the job fails."""
    return ranked(*frequent_sequences(written(pieces(docs, text, lang)), least, longest), top)


def ranked(totals: DataFrame, levels: list[DataFrame], top: int) -> DataFrame:
    """The ranks of collocations from the counts that frequent_sequences gives."""
    counts = levels[0].withColumn("size", F.lit(1))
    for size, level in enumerate(levels[1:], 2):
        counts = counts.unionByName(level.withColumn("size", F.lit(size)))
    phrases = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "size", F.split("gram", " ").alias("words"))

    # a phrase within any longer one that is as frequent lies in one of a single word more
    inside = lambda at: F.array_join(F.slice("words", at, F.col("size") - 1), " ")
    longer = phrases.where("size > 2").select("lang", "a", F.explode(F.array(inside(1), inside(2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where("coalesce(longer, 0) < a")

    cut = lambda k, at, size, side: F.struct(k.alias("k"), F.lit(side).alias("side"), F.array_join(F.slice("words", at, size), " ").alias("part"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(cut(k, F.lit(1), k, "l"), cut(k, k + 1, F.col("size") - k, "r"))))
    requests = kept.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    requests = written(requests.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))))
    asked = requests.select("lang", "part", "salt").distinct()
    answers = asked.join(counts.select("lang", F.col("gram").alias("part"), "f"), ["lang", "part"])
    parts = requests.join(answers, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"))
    scored = parts.join(totals, "lang").withColumns({"top": _whole("a") * _whole("n") * F.lit(1000).cast("decimal(38,0)"), "under": _whole("l") * _whole("r")})
    scored = scored.withColumn("score", F.expr("top div under"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "n", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = lowest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
