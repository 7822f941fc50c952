"""Rule-based findings over operational rows, and their grouping into incidents.

A finding has rule, severity, day, at, entities (array of strings), summary, sources (the source
rows that it cites, an array of strings) and data (map)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.components import connected_components

FINDING = ("rule", "severity", "day", "at", "entities", "summary", "sources", "data")


def finding(df: DataFrame, rule: str, severity: Column | str, day: Column, at: Column, entities: Sequence[Column], summary: Column, sources: Column | None = None, **data: Column) -> DataFrame:
    """df projected to the schema of findings; sources is an array of strings, null for none."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    cited = F.coalesce(F.array().cast("array<string>") if sources is None else sources, F.array().cast("array<string>"))
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(rule).alias("rule"), sev.alias("severity"), day.cast("date").alias("day"), at.cast("timestamp_ntz").alias("at"), F.array(*(e.cast("string") for e in entities)).alias("entities"), summary.alias("summary"), cited.alias("sources"), values.alias("data"))


def finding_id() -> Column:
    """A number for each finding, from its rule, day and entities: 60 bits of their SHA-256. It needs
    no order of all findings, and is the same in every run."""
    name = F.concat_ws("|", "rule", F.date_format("day", "yyyy-MM-dd"), F.array_join("entities", ","))
    return F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long")


def failed_with_errors(runs: DataFrame, errors: DataFrame, keys: Sequence[str], message: str, order: Sequence[str]) -> DataFrame:
    """Failed runs with n_errors and errors, the messages of their non-null errors in order.

    Errors are gathered per run before the join, so that it has one row per run on each side."""
    item = F.struct(*order, F.col(message).alias("_m"))
    per = errors.where(F.col(message).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_errors"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_m"]), "; ").alias("errors"))
    return runs.join(per, list(keys), "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))


def orphan_errors(errors: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors of runs that did not fail."""
    return errors.join(failed.select(*keys), list(keys), "left_anti")


def missing_runs(runs: DataFrame, who: str, day: str, least_share: float = 0.8) -> DataFrame:
    """(who, day) without a run, for those that ran on at least least_share of all days.

    The days are one row of an array that every eligible row is given; days are bounded by the
    calendar, and no pairs but those that are missing or present are made."""
    seen = runs.select(who, day).where(F.col(day).isNotNull()).distinct()
    days = seen.agg(F.collect_set(day).alias("_all"))
    own = seen.groupBy(who).agg(F.collect_set(day).alias("_own"))
    pairs = own.join(F.broadcast(days), F.lit(True)).where(F.size("_own") >= least_share * F.size("_all"))
    return pairs.select(who, F.explode(F.array_except("_all", "_own")).alias(day))


def volume_drop(volumes: DataFrame, keys: Sequence[str], value: str, factor: float = 0.5) -> DataFrame:
    """Rows under factor times the median of their group, where that is above zero."""
    med = F.median(value).over(Window.partitionBy(*(keys or [F.lit(0)])))
    return volumes.withColumn("median_v", med).where((F.col("median_v") > 0) & (F.col(value) < factor * F.col("median_v")))


def quality_outlier(values: DataFrame, keys: Sequence[str], value: str, deviations: float = 5.0, share: float = 0.3) -> DataFrame:
    """Rows with median_v and mad that lie more than `deviations` median absolute deviations and
    more than `share` of the median from it, and rows above zero where the median is zero.

    A deviation of zero counts as one. Medians are exact: per group, joined back on its keys."""
    med = values.groupBy(*keys).agg(F.median(value).alias("median_v"))
    rows = values.join(med, list(keys))
    mad = rows.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median_v"))).alias("mad"))
    rows = rows.join(mad.withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))), list(keys))
    off = F.abs(F.col(value) - F.col("median_v"))
    far = (F.col("median_v") > 0) & (off > deviations * F.col("mad")) & (off > share * F.col("median_v"))
    return rows.where(far | (F.col("median_v") == 0) & (F.col(value) > 0))


def findings_links(findings: DataFrame, fid: str = "fid", same_rule: Sequence[str] = (), adjacent: DataFrame | None = None, days: int = 1) -> DataFrame:
    """Links (a, b), a < b, of findings at most `days` apart that share an entity, have adjacent
    entities (columns src, dst), or are of one of the rules same_rule on the same day.

    Each finding is filed under the days it can meet and its entities; files are linked to
    their least member, first on their own day and then from day to day, so that many findings
    of an entity cost no pairs. Connectivity, not every pair, is kept."""
    rows = findings.select(F.col(fid).alias("id"), F.col("day").alias("day"), "rule", "entities")
    ent = rows.select("id", "day", F.explode("entities").alias("e"))
    day_hub = ent.groupBy("e", "day").agg(F.min("id").alias("hub"))
    same = ent.join(day_hub, ["e", "day"]).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    later = day_hub.select("e", F.explode(F.array(*(F.date_add("day", k) for k in range(1, days + 1)))).alias("day"), F.col("hub").alias("other"))
    near = day_hub.join(later, ["e", "day"]).select(F.col("hub").alias("a"), F.col("other").alias("b"))
    out = same.unionByName(near)
    if adjacent is not None:
        reach = day_hub.join(adjacent.select(F.col("src").alias("e"), "dst"), "e").select(F.col("dst").alias("e"), F.explode(F.array(*(F.date_add("day", k) for k in range(-days, days + 1)))).alias("day"), F.col("hub").alias("other"))
        out = out.unionByName(day_hub.join(reach, ["e", "day"]).select(F.col("hub").alias("a"), F.col("other").alias("b")))
    if same_rule:
        ruled = rows.where(F.col("rule").isin(*same_rule))
        hub = ruled.groupBy("rule", "day").agg(F.min("id").alias("hub"))
        out = out.unionByName(ruled.join(hub, ["rule", "day"]).select(F.col("hub").alias("a"), F.col("id").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_findings(findings: DataFrame, fid: str = "fid", **how) -> DataFrame:
    """findings with component, the least id of their group."""
    groups = connected_components(findings_links(findings, fid, **how), "a", "b")
    return findings.join(groups.withColumnRenamed("node", fid), fid, "left").withColumn("component", F.coalesce("component", F.col(fid)))


def incidents(grouped: DataFrame, small_rule: str = "sla_delay", prefix: str = "INC") -> DataFrame:
    """One row per group that is more than warnings of small_rule: key (prefix-MMDD, with b, c
    for more of a day), priority, counts, first finding (critical ones first), rules, entities."""
    rank = F.struct((F.col("severity") != "crit").alias("minor"), F.col("at"), F.col("fid"))
    per = grouped.groupBy("component").agg(
        F.bool_and((F.col("rule") == small_rule) & (F.col("severity") != "crit")).alias("_small"),
        F.bool_or(F.col("severity") == "crit").alias("_crit"),
        F.count("*").alias("n_findings"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min_by("summary", rank).alias("title"),
        F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))), ",").alias("entities"),
    )
    per = per.where("NOT _small").withColumn("nth", F.row_number().over(Window.partitionBy("first_day").orderBy("component")))
    letter = F.when(F.col("nth") == 1, "").when(F.col("nth") <= 26, F.chr(F.col("nth") + 96)).otherwise(F.concat(F.lit("-"), F.col("nth").cast("string")))
    key = F.concat(F.lit(f"{prefix}-"), F.date_format("first_day", "MMdd"), letter)
    return per.select("component", key.alias("key"), F.when(F.col("_crit"), "P2").otherwise("P3").alias("priority"), "n_findings", "first_day", "last_day", "title", "rules", "entities")
