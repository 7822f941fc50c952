"""Line dedup by content-defined chunks and by runs of lines, in DataFrame operations only.

A chunk of lines ends where a rolling hash over the last line hashes says so, and on either
side of a line that is long by itself; so boundaries depend on nearby content only and fall
alike wherever a passage stands. Short passages are found by chunks. Runs of lines of more than
50 words are found whole, wherever chunks end in them: from each line with words on, and back
from it, the fewest lines of over 50 words are a window, and every repeated run is the union of
windows that repeat. Chunks and windows are compared by SHA-256 of their bytes; those that an
earlier place has are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import n_words, shielded
from tidewright.session import cut

#: Lines that the rolling hash covers, and one in how many of its values ends a chunk.
ROLL, DIVISOR = 2, 2
#: A line of more words than this is a chunk by itself.
LONG_LINE = 50
#: Fewest words of a chunk that is removed.
LEAST_WORDS = 10
#: Runs of lines of more words than this are removed whole.
RUN_WORDS = 50


def _facts(text: Column, long_line: int) -> Column:
    """Array of structs (s, h, big, w): each line, its hash, whether it is long, its words."""
    gaps = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("s"), F.xxhash64(x).alias("h"), (gaps(x) >= long_line).alias("big"), n_words(x).alias("w")))


def _spans(f: Column, roll: int, divisor: int) -> Column:
    """Array of structs (a, b): the chunks of lines, b the line after the last."""

    def ends(i: Column) -> Column:
        rolled = F.xxhash64(*(F.get(f, i - back)["h"] for back in range(roll)))
        return (F.pmod(rolled, F.lit(divisor)) == 0) | F.get(f, i)["big"] | F.coalesce(F.get(f, i + 1)["big"], F.lit(True))

    stops = F.filter(F.transform(f, lambda _, i: F.when(ends(i), i + 1)), lambda e: e.isNotNull())
    pairs = F.transform(F.array(stops), lambda e: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), e, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return pairs[0]


def _body(f: Column, a: Column, b: Column) -> Column:
    return F.array_join(F.slice(f, a + 1, b - a)["s"], "\n")


def chunked(text: Column, roll: int = ROLL, divisor: int = DIVISOR, long_line: int = LONG_LINE) -> Column:
    """Array of structs (at, lines, big, body): the chunks of a text's \\n-separated lines.

    at counts from 0; lines is how many it has; big marks a line long by itself; the bodies
    joined by \\n are the text. Null gives null. Words of a line are counted by its spaces."""

    def bodies(f: Column) -> Column:
        def chunk(p: Column, at: Column) -> Column:
            return F.struct(at.alias("at"), (p["b"] - p["a"]).alias("lines"), F.get(f, p["a"])["big"].alias("big"), _body(f, p["a"], p["b"]).alias("body"))

        return F.transform(_spans(f, roll, divisor), chunk)

    # one-element arrays bind what they hold, so that it is evaluated once
    return F.when(text.isNotNull(), F.transform(F.array(_facts(text, long_line)), bodies)[0])


def _windows(f: Column, over: int) -> Column:
    """Array of structs (a, b): for each line with words the fewest lines of more than `over`
    words that begin with it, and those that end with it, if there are so many.

    Let lines i to j have over `over` words and stand elsewhere too. If those from i to k have
    as many, the window that ends with k lies in the run; if not, the one that begins with i
    does and holds k. So windows cover the run, and depend on its lines only."""
    live = F.filter(F.transform(f, lambda x, i: F.struct(i.alias("i"), x["w"].alias("w"))), lambda x: x["w"] > 0)
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("n"))
    reach = lambda xs: F.aggregate(xs, start, lambda s, x: F.when(s["w"] > over, s).otherwise(F.struct((s["w"] + x["w"]).alias("w"), (s["n"] + 1).alias("n"))))

    def both(v: Column) -> Column:
        def on(x: Column, k: Column) -> Column:
            return F.transform(F.array(reach(F.slice(v, k + 1, over + 1))), lambda r: F.when(r["w"] > over, F.struct(x["i"].alias("a"), (F.get(v, k + r["n"] - 1)["i"] + 1).alias("b"))))[0]

        def back(x: Column, k: Column) -> Column:
            low = F.greatest(k - over, F.lit(0))
            return F.transform(F.array(reach(F.reverse(F.slice(v, low + 1, k - low + 1)))), lambda r: F.when(r["w"] > over, F.struct(F.get(v, k - r["n"] + 1)["i"].alias("a"), (x["i"] + 1).alias("b"))))[0]

        return F.filter(F.concat(F.transform(v, on), F.transform(v, back)), lambda p: p.isNotNull())

    return F.transform(F.array(live), both)[0]


def _units(docs: DataFrame, doc_id: str, text: str, least_words: int, over: int | None, roll: int, divisor: int, long_line: int) -> DataFrame:
    """(id, mark, a, b, h) of each chunk and window that may be removed, one row a place."""

    def places(f: Column) -> Column:
        words = lambda p: F.aggregate(F.slice(f, p["a"] + 1, p["b"] - p["a"]), F.lit(0).cast("long"), lambda n, x: n + x["w"])
        found = F.filter(_spans(f, roll, divisor), lambda p: ((p["b"] - p["a"] > 1) | F.get(f, p["a"])["big"]) & (words(p) >= least_words))
        if over is not None:
            found = F.concat(found, _windows(f, over))
        # longs, since equal structs are looked for one by one
        packed = F.array_distinct(F.transform(found, lambda p: p["a"] * F.lit(1 << 32) + p["b"]))
        spread = F.transform(packed, lambda p: F.struct(F.shiftright(p, 32).cast("int").alias("a"), p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b")))
        return F.transform(spread, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.unhex(F.sha2(_body(f, p["a"], p["b"]), 256)).alias("h")))

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    rows = rows.select("id", F.xxhash64("text").alias("mark"), F.explode(F.transform(F.array(_facts(F.col("text"), long_line)), places)[0]).alias("u"))
    return rows.select("id", "mark", "u.a", "u.b", "u.h")


def _repeated(docs: DataFrame, doc_id: str, text: str, least_words: int, over: int | None, **how) -> DataFrame:
    """(id, mark, a, b, first_id): lines a to before b that are, byte for byte, at an earlier place.

    Occurrences are ordered by doc_id (nulls last), text hash and place. One that overlaps the
    first, in a text that repeats itself, is not counted: the first stays whole. Only hashes
    and places move."""
    found = cut(_units(docs, doc_id, text, least_words, over, **how))
    doc = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    place = F.struct(doc.alias("doc"), F.col("a").alias("a"))
    first = cut(found.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h", "first"))
    again = found.join(first, "h").where(~doc.eqNullSafe(F.col("first.doc")) | (F.col("a") >= F.col("first.a") + F.col("b") - F.col("a")))
    return again.select("id", "mark", "a", "b", F.col("first.doc.id").alias("first_id"))


def _merged(places: Column) -> Column:
    """Sorted structs (a, b) as unbroken stretches that neither overlap nor touch."""

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], p["b"]).alias("b"))
        joins = (F.size(acc) > 0) & (p["a"] <= F.try_element_at(acc, F.lit(-1))["b"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(places, F.array().cast("array<struct<a:int,b:int>>"), step)


def _without(text: Column, stretches: Column) -> Column:
    """The text's lines that are in none of the stretches, joined by \\n."""

    def kept(lines: Column) -> Column:
        starts = F.concat(stretches["a"], F.array(F.size(lines)))
        gaps = F.zip_with(F.concat(F.array(F.lit(0)), stretches["b"]), starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.array_join(F.transform(F.filter(gaps, lambda g: g["b"] > g["a"]), lambda g: F.array_join(F.slice(lines, g["a"] + 1, g["b"] - g["a"]), "\n")), "\n")

    return F.transform(F.array(F.split(text, "\n", -1)), kept)[0]


def _removed(docs: DataFrame, doc_id: str, text: str, least_words: int, over: int | None, **how) -> DataFrame:
    gone = _repeated(docs, doc_id, text, least_words, over, **how)
    gone = gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("_gone"), F.array_sort(F.collect_set("first_id")).alias("_firsts"))
    gone = gone.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), _merged(F.col("_gone")).alias("_gone"), "_firsts")
    joined = docs.join(gone, docs[doc_id].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text]) == gone["_mark"]), "left")
    touched = lambda f: F.filter(_spans(f, how["roll"], how["divisor"]), lambda c: F.exists("_gone", lambda g: (g["a"] < c["b"]) & (c["a"] < g["b"])))
    n_chunks = F.size(F.transform(F.array(_facts(F.col(text), how["long_line"])), touched)[0])
    n_lines = F.aggregate("_gone", F.lit(0).cast("long"), lambda n, g: n + g["b"] - g["a"])
    changed = F.col("_gone").isNotNull()
    clean = F.struct(
        F.when(changed, _without(F.col(text), F.col("_gone"))).otherwise(F.col(text)).alias("text"),
        F.when(changed, n_chunks).otherwise(F.lit(0)).cast("long").alias("n_chunks"),
        F.when(changed, n_lines).otherwise(F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_firsts", F.array().cast(f"array<{docs.schema[doc_id].dataType.simpleString()}>")).alias("first_ids"),
    )
    return joined.select(*(docs[c] for c in docs.columns), clean.alias("clean"))


@shielded(["doc_id", "text"], ["clean"])
def remove_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, roll: int = ROLL, divisor: int = DIVISOR, long_line: int = LONG_LINE) -> DataFrame:
    """docs with `clean`, a struct: text without its repeated chunks, n_chunks removed, n_lines
    removed, first_ids (distinct ids, sorted, of the documents that have them first).

    Chunks of one shorter line stay; see remove_repeats for whole passages. What is left of a
    text is its other chunks joined by \\n (empty if none). Null and empty texts stay. Copies
    lose all chunks that can be removed, for the first copy keeps them. Rows that repeat id and
    text can't be told apart and count as one document; they keep a row each and the same
    result. Rows without an id come last. An empty table gives an empty one; other columns are
    untouched.
    """
    return _removed(docs, doc_id, text, least_words, None, roll=roll, divisor=divisor, long_line=long_line)


@shielded(["doc_id", "text"], ["clean"])
def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, over: int = RUN_WORDS, roll: int = ROLL, divisor: int = DIVISOR, long_line: int = LONG_LINE) -> DataFrame:
    """As remove_repeated_chunks, and every run of lines of more than `over` words that an
    earlier place has goes whole; n_chunks counts chunks that lost lines.

    Blank lines at the ends of a run may stay. Copies of a text of more than `over` words lose
    all of their words."""
    return _removed(docs, doc_id, text, least_words, over, roll=roll, divisor=divisor, long_line=long_line)
