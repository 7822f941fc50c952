"""Aggregates of pipeline operations: SLAs, loads, funnels, facets, latest and last rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def success_rate(runs: DataFrame, keys: Sequence[str], ok: Column, digits: int = 1) -> DataFrame:
    """Runs and the percentage that went well."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.bround(100.0 * F.avg(ok.cast("double")), digits).alias("rate"))


def delays(runs: DataFrame, late: str, threshold: Column, critical: float = 60) -> DataFrame:
    """Runs later than their threshold, strictly, with `late` and severity."""
    found = runs.where(F.col(late) > threshold).withColumn("late", F.col(late))
    return found.withColumn("severity", F.when(F.col("late") >= critical, "crit").otherwise("warn"))


def sla_history(runs: DataFrame, keys: Sequence[str], late: str, threshold: float) -> DataFrame:
    """Runs, violations, median and longest delay per group."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(F.col(late) > threshold).alias("violations"), F.median(late).alias("p50"), F.max(late).alias("longest"))


def nearest_planned(runs: DataFrame, at: str, second_of_day: Column) -> DataFrame:
    """runs with planned, the nearest of the planned times on the day before, the day and the
    day after (ties: the earliest), and off_sec, how far the run is from it. No join: the three
    candidates are computed in the row."""
    day = F.date_trunc("day", F.col(at)).cast("timestamp_ntz")

    def candidate(k: int) -> Column:
        planned = day + F.make_dt_interval(days=F.lit(k), secs=second_of_day.cast("decimal(18,6)"))
        off = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(planned.cast("timestamp"))) / 1e6
        return F.struct(F.abs(off).alias("d"), F.lit(k).alias("k"), planned.alias("planned"), off.alias("off_sec"))

    best = F.array_min(F.array(*(candidate(k) for k in (-1, 0, 1))))
    return runs.withColumn("_best", best).withColumns({"planned": F.col("_best.planned"), "off_sec": F.col("_best.off_sec")}).drop("_best")


def sla_window(runs: DataFrame, at: str, start_second: Column, end_second: Column) -> DataFrame:
    """runs with expected_start and expected_end: the nearest planned start, and the end on its
    date, a day later where the end is before the start."""
    planned = nearest_planned(runs, at, start_second).withColumnRenamed("planned", "expected_start").drop("off_sec")
    day = F.date_trunc("day", "expected_start").cast("timestamp_ntz")
    over = F.when(end_second < start_second, 1).otherwise(0)
    return planned.withColumn("expected_end", day + F.make_dt_interval(days=over, secs=end_second.cast("decimal(18,6)")))


def load_stats(loads: DataFrame, key: str, day: str, value: str, drop: float = 0.5) -> DataFrame:
    """Per key: days, median, range, latest value and day, and days under `drop` of the median."""
    med = loads.withColumn("_med", F.median(value).over(Window.partitionBy(key)))
    return med.groupBy(key).agg(F.count("*").alias("days"), F.max("_med").alias("median_v"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, day).alias("latest"), F.max(day).alias("latest_day"), F.count_if(F.col(value) < drop * F.col("_med")).alias("drops"))


def click_rate(events: DataFrame, keys: Sequence[str], kind: str, click: str = "click", view: str = "view") -> DataFrame:
    """Clicks, views and clicks per hundred views; null without views."""
    n = events.groupBy(*keys).agg(F.count_if(F.col(kind) == click).alias("clicks"), F.count_if(F.col(kind) == view).alias("views"))
    return n.withColumn("ctr", F.bround(100.0 * F.col("clicks") / F.nullif(F.col("views"), F.lit(0)), 3))


def funnel(events: DataFrame, keys: Sequence[str], kind: str, steps: Sequence[str]) -> DataFrame:
    """Counts of each step in columns n_<step>, and the last step per first."""
    n = events.groupBy(*keys).agg(*(F.count_if(F.col(kind) == s).alias(f"n_{s}") for s in steps))
    return n.withColumn("conversion", F.col(f"n_{steps[-1]}") / F.nullif(F.col(f"n_{steps[0]}"), F.lit(0)))


def coverage(definitions: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """definitions with how often each was seen; gap if never."""
    n = seen.groupBy(*keys).agg(F.count("*").alias("n"))
    return definitions.join(n, list(keys), "left").withColumn("gap", F.col("n").isNull()).withColumn("n", F.coalesce("n", F.lit(0)))


def daily_metrics(events: DataFrame, day: str, kind: str, value: str) -> DataFrame:
    """(metric, day, v): success rate, errors, click rate and revenue of each day, unpivoted
    from one aggregation."""
    is_ = lambda k: F.col(kind) == k
    wide = events.groupBy(day).agg(
        (100.0 * F.avg((~is_("error")).cast("double"))).alias("success_rate"),
        F.count_if(is_("error")).cast("double").alias("errors"),
        (100.0 * F.count_if(is_("click")) / F.nullif(F.count_if(is_("view")), F.lit(0))).alias("ctr"),
        F.sum(F.when(is_("purchase"), F.col(value))).alias("revenue"),
    )
    return wide.unpivot([day], ["success_rate", "errors", "ctr", "revenue"], "metric", "v")


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per group and its count; of equals the least."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value)))
    return n.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{value}").alias("majority"), "b.n")


def facets(df: DataFrame, column: str, named: Sequence[str], other: str = "other", total: str = "total") -> DataFrame:
    """Counts by value with one bucket for values not named, and a total over the counts."""
    bucket = F.when(F.col(column).isin(*named), F.col(column)).otherwise(other)
    n = df.select(bucket.alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))
    return n.unionByName(n.agg(F.lit(total).alias("facet"), F.sum("n").alias("n")))


def waterfall(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """df with offset, the sum of the amounts before, and share of the group's sum."""
    w = Window.partitionBy(*keys)
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"offset": F.coalesce(F.sum(amount).over(before), F.lit(0.0)), "share": F.col(amount) / F.nullif(F.sum(amount).over(w), F.lit(0.0))})


def consecutive(df: DataFrame, keys: Sequence[str], order: Sequence[str], following: Mapping[str, str]) -> DataFrame:
    """Rows that have a next one in their group, with its columns under new names."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({new: F.lead(c).over(w) for c, new in following.items()}).withColumn("_more", F.lead(F.lit(1)).over(w))
    return rows.where("_more = 1").drop("_more")


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, with nth from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
