"""Uploaded files: what storing them would do, and storing, listing and deleting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.functions.linediff import line_changes
from tidewright.operators import history
from tidewright.operators.search import dictionary_spans
from tidewright.sources import convert

#: A document's own id in its text (fixed pattern).
DOC_ID = r"문서 ID\W+[A-Z]+-[A-Z]+-\d+"
AROUND = 50


def document_id(name: str | Column, prefix: str = "runbook:") -> Column:
    """The id of the document that a file becomes: its safe name without the extension."""
    return F.concat(F.lit(prefix), F.regexp_replace(tx.safe_name(name), r"\.[^.]*$", ""))


def preview(files: DataFrame, stored: DataFrame, names: DataFrame, prefix: str = "runbook:", most: int = 200) -> DataFrame:
    """One row per file (name, text): id, title, exists, markdown, added, removed, diff (at most
    `most` lines against the stored document), entities and checks.

    stored: (id, markdown), one row per document; names: (entity, name). entities is an array of
    (entity, surface, at, in_raw, snippet) by place, in_raw whether the surface stands in the
    file as it came; checks is an array of (check, ok): title, sections, doc_id, entities,
    warnings. Null text is an empty file; files of one id are previewed each by itself."""
    c = convert.converted(F.col("name"), F.col("text"))
    rows = files.select(document_id("name", prefix).alias("id"), F.col("name"), F.coalesce("text", F.lit("")).alias("raw"), c.alias("c"))
    rows = rows.select("id", "name", "raw", F.col("c.markdown").alias("markdown"), F.size("c.warnings").alias("n_warnings"))
    found = dictionary_spans(rows, names, "name", "markdown")
    # places come with the file's name only, so that texts are joined once and not per entity
    places = found.groupBy(F.col("id").alias("name")).agg(F.array_sort(F.collect_list(F.struct("at", "entity", F.col("name").alias("surface")))).alias("places"))
    rows = rows.join(places, "name", "left").join(stored.select("id", F.col("markdown").alias("was")), "id", "left")
    low = tx.folded("raw")
    around = lambda p: F.replace(F.substring(F.col("markdown"), F.greatest(F.lit(1), p["at"] - AROUND), F.least(p["at"] - 1, F.lit(AROUND)) + F.char_length(p["surface"]) + AROUND), F.lit("\n"), F.lit(" "))
    entities = F.transform(F.coalesce("places", F.array()), lambda p: F.struct(p["entity"].alias("entity"), p["surface"].alias("surface"), p["at"].alias("at"), F.contains(low, tx.folded(p["surface"])).alias("in_raw"), around(p).alias("snippet")))
    rows = rows.withColumn("entities", entities)
    titled = F.startswith(F.ltrim("markdown"), F.lit("# "))
    head = F.btrim(F.regexp_extract("markdown", r"(?m)^# (.*)$", 1))
    n_sections = tx.occurrences("markdown", "\n## ")
    check = lambda name, ok: F.struct(F.lit(name).alias("check"), ok.alias("ok"))
    checks = F.array(check("title", titled), check("sections", n_sections > 0), check("doc_id", F.col("markdown").rlike(DOC_ID)), check("entities", F.size("entities") > 0), check("warnings", F.col("n_warnings") == 0))
    rows = rows.withColumn("d", F.when(F.col("was").isNotNull(), line_changes(F.col("was"), F.col("markdown"), 1, most)))
    title = F.when(head != "", head).otherwise(F.substring("id", len(prefix) + 1, 1000))
    return rows.select("id", "name", title.alias("title"), F.col("was").isNotNull().alias("exists"), "markdown", n_sections.alias("n_sections"), F.coalesce("d.added", F.lit(0)).alias("added"), F.coalesce("d.removed", F.lit(0)).alias("removed"), F.coalesce("d.diff", F.array()).alias("diff"), "entities", checks.alias("checks"))


def commit(previewed: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions (id, version, hash, markdown) that storing previewed files appends: those
    whose content is not the document's last one. Storing the same files again appends nothing."""
    new = previewed.select("id", history.content_hash("markdown").alias("hash"), "markdown")
    out = history.upsert(versions.select("id", "version", "hash"), new, "id")
    return out.where("action <> 'unchanged'").select("id", "version", "hash", "markdown")


def listing(files: DataFrame, versions: DataFrame, prefix: str = "runbook:") -> DataFrame:
    """Files (name, text) with their size in bytes, document id and last version, if stored."""
    last = history.current(versions.select("id", "version"), "id")
    rows = files.select("name", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), document_id("name", prefix).alias("id"))
    return rows.join(last, "id", "left").select("name", "bytes", "id", "version")


def delete(files: DataFrame, versions: DataFrame, edges: DataFrame, gone: DataFrame, prefix: str = "runbook:") -> tuple[dict[str, DataFrame], DataFrame]:
    """Files, versions and edges without all that the files named in gone (name) left, and
    (table, n) of the rows that go."""
    names = gone.select("name").distinct()
    ids = names.select(document_id("name", prefix).alias("id")).distinct()
    before = {"files": files, "versions": versions, "edges": edges}
    ends = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    left = {"files": files.join(names, "name", "left_anti"), "versions": versions.join(ids, "id", "left_anti"), "edges": ends.select(*edges.columns)}
    one = lambda t, df, sign: df.agg((F.count("*") * sign).alias("n")).select(F.lit(t).alias("table"), "n")
    counts = None
    for t, df in before.items():
        both = one(t, df, 1).unionByName(one(t, left[t], -1))
        counts = both if counts is None else counts.unionByName(both)
    return left, counts.groupBy("table").agg(F.sum("n").alias("n"))
