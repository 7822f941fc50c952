"""License scans by canonical digest, in DataFrame operations only.

A text is reduced to a canonical form that case, punctuation, copyright lines and spelling
variants do not change; its digest is looked up among the digests of known licences by a hash
join. A document is looked up as a whole, and so is each of its lines, as a notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut

#: Spellings that mean the same once case, punctuation and spaces are even: from, to. Applied in
#: this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub licens", "sublicens"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("share alike", "sharealike"),
    ("no derivatives", "noderivatives"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("copyright holders", "copyright holder"),
    ("copyright owner", "copyright holder"),
)
#: A line of copyright, with the line break before it.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: What counts as punctuation or space: ASCII but letters and digits, and typographic signs.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F ‐-―‘-‟•…«»·]+"
#: Known licences are broadcast if there are at most so many digests.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Canonical form of a text: null stays null, a text without words becomes empty."""
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    c = F.btrim(F.regexp_replace(c, PUNCTUATION, " "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the canonical form; null if that has no words."""
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def known_digests(licenses: DataFrame, license_id: str = "license_id", text: str = "text") -> DataFrame:
    """(digest, license_id), one row per digest: of licences with the same canonical text, the
    least id stands for all. Null and wordless texts are unknown."""
    rows = licenses.select(F.col(license_id).alias("license_id"), digest(F.col(text)).alias("digest"))
    return rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text", license_id: str = "license_id", license_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, license_id (of the whole text, or null), notices (ids of
    lines that are known texts by themselves; distinct, sorted), n_notice_lines.

    Whole texts are compared, never parts of them; \\n ends a line. Null and empty texts match
    nothing. Rows that repeat id and text have the same result; ids may be null; other columns
    are not read. The digests of a row's lines are counted before they are joined."""
    known = cut(known_digests(licenses, license_id, license_text))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(F.col("text")).alias("digest"))), F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest"))))
    units = rows.where("text IS NOT NULL").select("doc_id", "mark", F.explode(units).alias("u")).select("doc_id", "mark", "u.whole", "u.digest")
    hits = units.join(known, "digest").groupBy("doc_id", "mark").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))).alias("notices"),
        F.count_if(~F.col("whole")).alias("n"),
    )
    # rows that repeat id and text have each added their lines
    copies = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    hits = hits.join(copies, hits["doc_id"].eqNullSafe(copies["doc_id"]) & (hits["mark"] == copies["mark"])).select(hits["doc_id"].alias("_id"), hits["mark"].alias("_mark"), "license_id", "notices", (F.col("n") / F.col("copies")).cast("long").alias("n"))
    out = rows.select("doc_id", "mark").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    return out.select("doc_id", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n", F.lit(0)).alias("n_notice_lines"))


def default_licenses(spark) -> DataFrame:
    """The known texts and notices that come with the library."""
    from tidewright.llm.license_texts import catalogue

    return spark.createDataFrame(catalogue(), "license_id string, text string")
