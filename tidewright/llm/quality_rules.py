"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, fresh, shielded, words

#: Words of a window, and the base rule's least words and most per cent of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Characters that count as symbols (fixed by the contract of the query).
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish (a fixed word list).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "with", "as", "was", "on", "are", "by", "this", "be", "at", "from", "or",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "avec", "en",
    "el", "los", "las", "del", "y", "que", "se", "por", "con", "para", "una", "su", "al", "lo", "como", "más", "no", "es", "o", "un",
)


class Rule(NamedTuple):
    """A document passes if value, of the statistics below, lies in [least, most]; a null end is
    open. It applies to documents of at least from_words words."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table. Values are SQL over the statistics n_words, word_chars, n_symbols,
#: n_marks (! and ?), n_dup_lines, n_lines, n_distinct and n_stop.
RULES = (
    Rule("word_length", "word_chars / n_words", 2, 14),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("marks", "n_marks / n_words", None, 0.3),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("distinct_words", "n_distinct / n_words", 0.1, None, 50),
    Rule("stop_words", "n_stop / n_words", 0.01, None, 50),
)


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of an array stand in windows that it holds twice or more (long).

    Windows are compared by the 64-bit hash of their words' hashes."""
    def hashes(h: Column) -> Column:
        spans = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(F.array().cast("array<int>"))
        return F.transform(spans, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    def again(s: Column) -> Column:
        met = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return _bind(F.sort_array(F.filter(met, lambda i: i.isNotNull())), covered)

    def count(v: Column) -> Column:
        ordered = F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(_bind(ordered, again))

    return _bind(_bind(F.transform(w, lambda x: F.xxhash64(x)), hashes), count)


def statistics(w: Column, text: Column) -> dict[str, Column]:
    """Counts over a text (not null) and its array of words w, all long."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    n = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.translate(text, SPACES, "")),
        "n_symbols": without(SYMBOLS),
        "n_marks": without("!?"),
        "n_lines": F.size(lines),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_stop": F.size(F.filter(w, lambda x: x.isin(*sorted(set(STOP_WORDS))))),
    }
    return {k: v.cast("long") for k, v in n.items()}


def compile_rules(rules: Sequence[Rule], names: dict[str, str]) -> Column:
    """One boolean column: every rule holds of the statistics in the columns `names`. A value
    that is null (nothing to divide by) holds."""
    ok = F.lit(True)
    for r in rules:
        parts = [F.expr(re.sub(r"\b[a-z]\w*", lambda m: f"`{names[m[0]]}`", p)).cast("double") for p in r.value.split("/")]
        v = F.try_divide(*parts) if len(parts) == 2 else parts[0]
        inside = (v >= r.least if r.least is not None else F.lit(True)) & (v <= r.most if r.most is not None else F.lit(True))
        ok &= F.coalesce(inside, F.lit(True)) | (F.col(names["n_words"]) < r.from_words)
    return ok


@shielded(["text"], ["quality"])
def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with a struct column `quality`: the statistics, n_repeat_words, base_failed, kept.

    Words are `[^\\x20\\x09-\\x0D]+`; null is as an empty text: no words, base_failed. Lines are
    \\n-split and count if they have a word. base_failed: under 20 words, or more than 30 % of
    the words in repeated windows. kept: neither base_failed nor outside a rule. Every row is
    judged alone and whole; columns of the same names as the statistics stay as they were.
    """
    t, w = fresh(docs, "quality_text", "quality_words")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(w, words(F.col(t)))
    found = statistics(F.col(w), F.col(t)) | {"n_repeat_words": repeated_words(F.col(w))}
    # plain columns: a struct would be taken apart and computed for each use
    names = dict(zip(found, fresh(rows, *(f"quality_{k}" for k in found)), strict=True))
    rows = rows.withColumns({names[k]: c for k, c in found.items()})
    n = {k: F.col(c) for k, c in names.items()}
    base = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED * n["n_words"])
    kept = ~base & compile_rules(rules, names)
    return rows.select(*own, F.struct(*(c.alias(k) for k, c in n.items()), base.alias("base_failed"), kept.alias("kept")).alias("quality"))
