"""Health of index families: checks over versions, aliases, builders and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import glob_regex


def map_diff(old: Column, new: Column) -> Column:
    """Struct of sorted keys added, removed and changed between two maps (null: empty)."""
    a, b = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    changed = F.filter(both, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.struct(F.array_sort(F.array_except(F.map_keys(b), F.map_keys(a))).alias("added"), F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b))).alias("removed"), F.array_sort(changed).alias("changed"))


def family_versions(indices: DataFrame, families: DataFrame) -> DataFrame:
    """indices with their family, numbered from the newest; families is a small dimension of
    (family, pattern, alias, max_age_hours)."""
    rows = indices.join(F.broadcast(families), F.call_function("rlike", F.col("index"), glob_regex(F.col("pattern"))))
    w = Window.partitionBy("family").orderBy(F.desc("created"), F.desc("index"))
    return rows.withColumns({"nth": F.row_number().over(w), "older_mapping": F.lead("mapping").over(w)})


def mapping_changes(versions: DataFrame) -> DataFrame:
    """(family, diff): how the newest version's mapping differs from the one before; reported,
    never a fault."""
    return versions.where("nth = 1 AND older_mapping IS NOT NULL").select("family", map_diff(F.col("older_mapping"), F.col("mapping")).alias("diff"))


def check_families(indices: DataFrame, families: DataFrame, aliases: DataFrame, builders: DataFrame, now: Column, drop: float = 0.2, swappers: DataFrame | None = None) -> DataFrame:
    """(family, check, severity, detail): what is wrong with each index family.

    Every version: red is crit, yellow warn. The alias: without a target in the family crit; its
    target older than max_age_hours crit; not at the newest version warn, and then fewer
    documents there than in the target by more than `drop` crit. builders and swappers (family,
    builder_state or swapper_state, paused for builders): a failed last run is crit, another that
    is no success warn; a paused builder warn."""
    versions = family_versions(indices, families)
    fault = lambda cond, check, severity, detail: F.when(cond, F.struct(F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), detail.cast("string").alias("detail")))
    run = lambda state, check: fault(state != "success", check, F.when(state == "failed", "crit").otherwise("warn"), state)
    ill = versions.where(F.col("health").isin("red", "yellow")).select("family", fault(F.lit(True), "health", F.when(F.col("health") == "red", "crit").otherwise("warn"), F.col("index")).alias("c"))

    targets = aliases.select("alias", F.col("index").alias("_target"))
    newest = versions.where("nth = 1").select("family", F.col("index").alias("_newest"), F.col("docs").alias("_docs"))
    current = versions.join(F.broadcast(targets), "alias").where(F.col("index") == F.col("_target")).select("family", F.col("index").alias("_current"), F.col("created").alias("_created"), F.col("docs").alias("_had"))
    rows = families.join(newest, "family", "left").join(current, "family", "left").join(F.broadcast(builders), "family", "left")
    age = (F.unix_timestamp(now) - F.unix_timestamp("_created")) / 3600
    behind = F.col("_newest") != F.col("_current")
    checks = F.array(
        fault(F.col("_current").isNull(), "alias", "crit", F.col("alias")),
        fault(age > F.col("max_age_hours"), "age", "crit", F.floor(age)),
        fault(behind, "alias", "warn", F.col("_current")),
        fault(behind & (F.col("_had") > 0) & (1 - F.col("_docs") / F.col("_had") > drop), "documents", "crit", F.col("_had") - F.col("_docs")),
        fault(F.col("paused"), "paused", "warn", F.lit("true")),
        run(F.col("builder_state"), "builder"),
    )
    found = ill.unionByName(rows.select("family", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")))
    if swappers is not None:
        found = found.unionByName(swappers.select("family", run(F.col("swapper_state"), "swapper").alias("c")).where("c IS NOT NULL"))
    return found.select("family", "c.*")


def family_levels(families: DataFrame, checks: DataFrame) -> DataFrame:
    """(family, level, n_checks): crit, warn or ok; critical checks decide."""
    n = checks.groupBy("family").agg(F.bool_or(F.col("severity") == "crit").alias("_c"), F.count("*").alias("n_checks"))
    return families.select("family").join(n, "family", "left").select("family", F.when(F.col("_c"), "crit").when(F.col("n_checks") > 0, "warn").otherwise("ok").alias("level"), F.coalesce("n_checks", F.lit(0)).alias("n_checks"))
