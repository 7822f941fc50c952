"""Metric evaluation over trailing windows, and roll-ups of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluate(points: DataFrame, metric: str, at: str, value: str, slo: str | None = None, at_least: bool | Column = True, higher_is_better: bool | Column = True, frame: int = 7, near: float = 0.05, sigmas: float = 3.0, least: int = 5) -> DataFrame:
    """points with avg_prev, delta_pct, delta_good, state and anomaly, judged row by row.

    The history of a point is the `frame` positions before it; nulls in it count as positions
    but not as values. state: nodata (null value), breach (SLO not met), near (met, within
    `near` of it), ok (else, or no SLO). anomaly: at least `least` values of history, a spread
    above zero, and more than `sigmas` population deviations from their mean."""
    before = Window.partitionBy(metric).orderBy(at).rowsBetween(-frame, -1)
    v = F.col(value)
    avg, sd, n = (f(value).over(before) for f in (F.avg, F.stddev_pop, F.count))
    out = points.withColumn("avg_prev", avg).withColumn("sd_prev", sd).withColumn("n_prev", n)
    delta = (v - F.col("avg_prev")) / F.nullif(F.col("avg_prev"), F.lit(0.0)) * 100
    flag = lambda b: F.lit(b) if isinstance(b, bool) else b
    limit = F.col(slo) if slo else F.lit(None).cast("double")
    met = F.when(flag(at_least), v >= limit).otherwise(v <= limit)
    close = F.abs(v - limit) / F.coalesce(F.nullif(F.abs(limit), F.lit(0.0)), F.lit(1.0)) < near
    state = F.when(v.isNull(), "nodata").when(limit.isNull(), "ok").when(~met, "breach").when(close, "near").otherwise("ok")
    odd = (F.col("n_prev") >= least) & (F.col("sd_prev") > 0) & (F.abs(v - F.col("avg_prev")) / F.nullif(F.col("sd_prev"), F.lit(0.0)) > sigmas)
    return (
        out.withColumn("delta_pct", delta)
        .withColumn("delta_good", (F.col("delta_pct") >= 0) == flag(higher_is_better))
        .withColumn("state", state)
        .withColumn("anomaly", F.coalesce(odd, F.lit(False)))
        .drop("sd_prev", "n_prev")
    )


def latest(points: DataFrame, metric: str, at: str, *columns: str) -> DataFrame:
    """The last point of each metric, one row per metric, without a sort."""
    return points.groupBy(metric).agg(F.max(at).alias(at), *(F.max_by(c, at).alias(c) for c in columns))


def category_rollup(states: DataFrame, category: str, metric: str, state: str = "state") -> DataFrame:
    """Per category: metrics, counts of each state, breaches (nodata included), and metric ids
    from worst to best."""
    rank = F.when(F.col(state) == "breach", 0).when(F.col(state) == "nodata", 1).when(F.col(state) == "near", 2).otherwise(3)
    n = {s: F.count_if(F.col(state) == s) for s in ("breach", "nodata", "near", "ok")}
    order = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col(metric).alias("id"))))
    return states.groupBy(category).agg(F.count("*").alias("n_metrics"), *(c.alias(f"n_{s}") for s, c in n.items()), (n["breach"] + n["nodata"]).alias("breaches"), F.array_join(F.transform(order, lambda x: x["id"]), ",").alias("worst_first"))


def default_slo(points: DataFrame, metric: str, value: str, factor: float = 0.6) -> DataFrame:
    """An SLO for metrics that have none: factor times the median, rounded half to even."""
    return points.groupBy(metric).agg(F.bround(F.lit(factor) * F.median(value), 0).alias("slo"))


def scaled(points: DataFrame, metric: str, value: str) -> DataFrame:
    """Min-max scaling within each metric; null where all values are equal."""
    w = Window.partitionBy(metric)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return points.withColumn("scaled", (F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def ratio_by(df: DataFrame, keys: Sequence[str], top: Column, bottom: Column, scale: float = 100.0) -> DataFrame:
    """scale * sum(top) / sum(bottom) per group; null where the bottom is zero."""
    return df.groupBy(*keys).agg((scale * F.sum(top) / F.nullif(F.sum(bottom), F.lit(0))).alias("ratio"))
