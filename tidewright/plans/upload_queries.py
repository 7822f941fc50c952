"""Versions held against one another, and files that are to be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.linediff import line_changes
from tidewright.operators import uploads
from tidewright.plans.registry import Registry
from tidewright.session import table

registry = Registry()

#: Names that are looked for in files.
NAMES = [("licence:mit", "MIT License"), ("licence:apache", "Apache License"), ("word:the", "the"), ("word:ver", "verst"), ("word:eau", "eaux"), ("letter:u", "über")]


def altered(text: str | Column) -> Column:
    """A made-up earlier version: every fifth line is missing, every seventh stands twice, the last
    one is in capitals."""
    lines = F.split(text, "\n", -1)
    kept = F.flatten(F.transform(lines, lambda x, i: F.when(i % 5 == 3, F.array().cast("array<string>")).when(i % 7 == 6, F.array(x, x)).otherwise(F.array(x))))
    last = F.when(F.size(kept) > 0, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.upper(F.element_at(kept, -1)))))
    return F.array_join(last, "\n")


@registry.add()
def version_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added to and removed from every text since an earlier version, and the hash of the
    diff, at most 200 lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", altered("text").alias("old"))
    d = d.select("doc_id", line_changes(F.col("old"), F.col("text")).alias("c"))
    return d.select("doc_id", "c.added", "c.removed", F.size("c.diff").cast("long").alias("n_diff"), F.sha2(F.array_join("c.diff", "\n"), 256).alias("diff_sha256"))


@registry.add("""WITH n AS (SELECT * FROM (VALUES """ + ", ".join(f"('{e}', '{n}')" for e, n in NAMES) + """) v(entity, name)),
m AS (SELECT doc_id, lang, '# ' || source || chr(10) || text AS md FROM documents),
e AS (SELECT doc_id, count(*) AS n FROM m JOIN n ON regexp_matches(md, '(?i)(^|[^A-Za-z0-9_])' || name || '($|[^A-Za-z0-9])') GROUP BY 1)
SELECT 'runbook:doc-' || m.doc_id AS id, trim(split_part(substr(md, 3), chr(10), 1)) AS title, lang = 'en' AS exists, coalesce(n, 0) AS n_entities, coalesce(n, 0) AS n_in_raw,
  ((length(md) - length(replace(md, chr(10) || '## ', ''))) // 4)::BIGINT AS n_sections,
  'title:true,sections:' || contains(md, chr(10) || '## ') || ',doc_id:false,entities:' || (coalesce(n, 0) > 0) || ',warnings:true' AS checks
FROM m LEFT JOIN e USING (doc_id)""")
def upload_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as uploaded files: what they would become, and five checks of quality. The English
    ones are stored already, in an earlier version."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("# "), "source", F.lit("\n"), "text").alias("text"))
    stored = d.where("lang = 'en'").select(F.concat(F.lit("runbook:doc-"), F.col("doc_id").cast("string")).alias("id"), altered("text").alias("markdown"))
    p = uploads.preview(files, stored, spark.createDataFrame(NAMES, "entity string, name string"))
    checks = F.array_join(F.transform("checks", lambda c: F.concat(c["check"], F.lit(":"), c["ok"].cast("string"))), ",")
    n_in_raw = F.size(F.filter("entities", lambda e: e["in_raw"]))
    return p.select("id", "title", "exists", F.size("entities").cast("long").alias("n_entities"), n_in_raw.cast("long").alias("n_in_raw"), "n_sections", checks.alias("checks"))
