"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers and words (fixed patterns).
IDENT, WORD = r"[A-Za-z0-9][A-Za-z0-9_.\-]*", r"[\p{L}\p{N}_]+"
#: A number and its unit.
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: What a snippet leaves out, with what stands in its place (fixed patterns).
MARKUP = [
    (r"```[\s\S]*?```", " "),
    (r"(?m)^(?:!!!|\?\?\?) *\w+ *", ""),
    (r"<!--.*?-->|[#>*`|!\[\]\"]|\(/e/[^)]*\)|-{3,}", " "),
    (r"\s+", " "),
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column, pattern: str = r"[a-z0-9_]+") -> Column:
    """All matches of pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(pattern), F.lit(0))


def ident_tokens(text: str | Column) -> Column:
    """Identifiers in the lower-cased text, each whole, with . and - as _, and then its parts;
    a word of one part counts twice, and repeats stay, so that terms can be counted."""
    found = tokens(text, IDENT)
    pieces = lambda x: F.filter(F.split(x, "[._-]"), lambda p: p != "")
    return F.flatten(F.transform(found, lambda x: F.concat(F.array(F.regexp_replace(x, "[.-]", "_")), pieces(x))))


def ident_terms(text: str | Column) -> Column:
    """The same tokens in another order, all wholes before all parts: cheaper, for counting."""
    whole = F.transform(tokens(text, IDENT), lambda x: F.translate(x, ".-", "__"))
    return F.concat(whole, tokens(text, "[a-z0-9]+"))


def bigrams(text: str | Column, letters: str) -> Column:
    """Overlapping two-character pieces of each run of `letters` (a regex class); a run of one
    stays as it is."""
    pattern = f"(?=({letters}{{2}}|(?<!{letters}){letters}(?!{letters})))"
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(1))


def strip_front_matter(text: str | Column) -> Column:
    """A page without the YAML block it starts with."""
    return F.regexp_replace(col(text), r"(?s)\A---\n.*?\n---\n", "")


def plain(markdown: str | Column) -> Column:
    """Markdown as plain text: no front matter, fences, link targets, table bars and marks."""
    t = strip_front_matter(markdown)
    for pattern, to in ((r"(?s)```.*?```", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}[#>]+\s*", ""), (r"[|*`]", " "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(t)


def sections(text: str | Column) -> Column:
    """Array of structs (section, body): the part before the first `## ` heading has an empty
    section; blank parts are left out; a body repeats its heading."""
    parts = F.split(col(text), "(?m)^## ")
    named = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, F.lit("")).otherwise(F.btrim(F.substring_index(p, "\n", 1))).alias("section"), F.when(i == 0, p).otherwise(F.concat(F.lit("## "), p)).alias("body")))
    return F.filter(named, lambda s: F.btrim(s["body"], F.lit(" \n\t\r")) != "")


def snippet(text: str | Column, query: str, width: int = 90) -> Column:
    """`width` characters of the text without markup, from a third of that before the first place
    of the query's longest word (or of its first two characters; else of the next word; the start
    if none is there), with ellipses where text is cut. Words of one character don't count."""
    plain = col(text)
    for pattern, by in MARKUP:
        plain = F.regexp_replace(plain, pattern, by)
    words = sorted({w for w in query.lower().split() if len(w) >= 2}, key=lambda w: (-len(w), w))

    def cut(t: Column) -> Column:
        place = [F.nullif(F.locate(piece, F.lower(t)), F.lit(0)) for w in words for piece in (w, w[:2])]
        start = F.greatest(F.lit(1), F.coalesce(*place, F.lit(1)) - width // 3)
        rest = F.when(start + width - 1 < F.char_length(t), "…").otherwise("")
        return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(t, start, F.lit(width)), rest)

    return F.transform(F.array(F.btrim(plain)), cut)[0]


def highlight(text: str | Column, terms: list[str]) -> Column:
    """HTML-escaped text with the terms in bold, the longest first, whatever their case."""
    import re

    t = F.replace(F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pattern = "|".join(re.escape(x) for x in sorted(set(terms), key=lambda x: (-len(x), x)))
    return F.regexp_replace(t, f"(?i)({pattern})", "<b>$1</b>") if pattern else t


def holds_name(text: Column, name: Column) -> Column:
    """Does a name stand in a text, whatever the case in any script: no letter, digit or _ before it and no
    letter or digit after (a _ may follow)."""
    quoted = F.concat(F.lit(r"(?iu)(^|[^A-Za-z0-9_])\Q"), name, F.lit(r"\E($|[^A-Za-z0-9])"))
    return F.call_function("rlike", text, quoted)


def folded(text: str | Column) -> Column:
    """Lower-cased text in which the two letters with a second small form (long s, final sigma)
    have one, as holds_name compares them."""
    return F.translate(F.lower(col(text)), "ſς", "sσ")


def slug(text: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def safe_name(name: str | Column, most: int = 80) -> Column:
    """The last part of a path with unusual characters as _, at most so many characters."""
    base = F.regexp_replace(col(name), r"^.*[/\\]", "")
    return F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}._-]+", "_"), 1, most)


def line_of(text: str | Column, needle: str | Column) -> Column:
    """Number of the line with a string's first place; null if it has none."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    at = F.call_function("locate", n, col(text))
    return F.when(at > 0, F.size(F.split(F.substring(col(text), F.lit(1), at), "\n")))


def occurrences(text: str | Column, needle: str) -> Column:
    """How often a string stands in a text, without overlaps."""
    t = col(text)
    return ((F.char_length(t) - F.char_length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def duration_text(seconds: Column) -> Column:
    """H h M min, or M min below an hour."""
    h, m = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.when(h > 0, F.format_string("%d h %d min", h.cast("long"), m.cast("long"))).otherwise(F.format_string("%d min", m.cast("long")))


def ago(then: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(s < 3600, F.concat(F.floor(s / 60), F.lit(" min"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit(" h"))).otherwise(F.concat(F.floor(s / 86400), F.lit(" d")))


def glob_regex(pattern: Column) -> Column:
    """A file-name pattern (*, ?) as a whole-string regular expression."""
    p = F.regexp_replace(pattern, r"([.\\+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(p, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
