"""Metric, load, funnel and quality aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import metrics, opsagg
from tidewright.plans.registry import Registry
from tidewright.session import table

registry = Registry()

DAILY_SQL = "SELECT event_type AS metric, CAST(date_trunc('day', ts) AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, day, v): the daily sum of each event type."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


EVALUATED_SQL = f"""
WITH p AS ({DAILY_SQL}),
s AS (SELECT metric, 0.97 * median(v) AS slo FROM p GROUP BY 1),
w AS (SELECT metric, day, v, slo, avg(v) OVER h AS a, stddev_pop(v) OVER h AS sd, count(v) OVER h AS n
      FROM p JOIN s USING (metric) WINDOW h AS (PARTITION BY metric ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
e AS (SELECT metric, day, v, slo, a AS avg_prev, (v - a) / nullif(a, 0) * 100 AS delta_pct, (v - a) / nullif(a, 0) * 100 >= 0 AS delta_good,
      CASE WHEN v IS NULL THEN 'nodata' WHEN v < slo THEN 'breach' WHEN abs(v - slo) / coalesce(nullif(abs(slo), 0), 1) < 0.05 THEN 'near' ELSE 'ok' END AS state,
      coalesce(n >= 5 AND sd > 0 AND abs(v - a) / nullif(sd, 0) > 3, false) AS anomaly FROM w)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = daily(spark, sf_dir)
    slo = p.groupBy("metric").agg((0.97 * F.median("v")).alias("slo"))
    return metrics.evaluate(p.join(slo, "metric"), "metric", "day", "v", "slo")


@registry.add(EVALUATED_SQL + "SELECT metric, day, round(v, 6) AS v, round(slo, 6) AS slo, round(avg_prev, 6) AS avg_prev, round(delta_pct, 6) AS delta_pct, delta_good, state, anomaly FROM e")
def metric_slo_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every daily point against its trailing window and SLO."""
    r = [F.round(c, 6).alias(c) for c in ("v", "slo", "avg_prev", "delta_pct")]
    return evaluated(spark, sf_dir).select("metric", "day", *r, "delta_good", "state", "anomaly")


@registry.add(EVALUATED_SQL + """SELECT metric, max(day) AS day, round(max_by(v, day), 6) AS v, round(max_by(avg_prev, day), 6) AS avg_prev, max_by(state, day) AS state,
round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS points FROM e GROUP BY metric""")
def metric_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last point of each metric with the range of all."""
    e = evaluated(spark, sf_dir)
    return e.groupBy("metric").agg(F.max("day").alias("day"), F.round(F.max_by("v", "day"), 6).alias("v"), F.round(F.max_by("avg_prev", "day"), 6).alias("avg_prev"), F.max_by("state", "day").alias("state"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.count("*").alias("points"))


@registry.add(EVALUATED_SQL + """, c AS (SELECT CASE WHEN metric IN ('purchase', 'signup') THEN 'business' WHEN metric = 'error' THEN 'health' ELSE 'traffic' END AS category, metric, max_by(state, day) AS state FROM e GROUP BY metric)
SELECT category, count(*) AS n_metrics, count_if(state = 'breach')::BIGINT AS n_breach, count_if(state = 'nodata')::BIGINT AS n_nodata, count_if(state = 'near')::BIGINT AS n_near, count_if(state = 'ok')::BIGINT AS n_ok,
count_if(state IN ('breach', 'nodata'))::BIGINT AS breaches, string_agg(metric, ',' ORDER BY CASE state WHEN 'breach' THEN 0 WHEN 'nodata' THEN 1 WHEN 'near' THEN 2 ELSE 3 END, metric) AS worst_first FROM c GROUP BY category""")
def metric_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State counts of each category of metrics."""
    last = metrics.latest(evaluated(spark, sf_dir), "metric", "day", "state")
    category = F.when(F.col("metric").isin("purchase", "signup"), "business").when(F.col("metric") == "error", "health").otherwise("traffic")
    return metrics.category_rollup(last.withColumn("category", category), "category", "metric")


@registry.add(f"SELECT metric, round_even(0.6 * median(v), 0) AS slo FROM ({DAILY_SQL}) GROUP BY metric")
def default_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An SLO for each metric from its median."""
    return metrics.default_slo(daily(spark, sf_dir), "metric", "v")


@registry.add(f"SELECT metric, day, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS scaled FROM ({DAILY_SQL}) WINDOW w AS (PARTITION BY metric)")
def metric_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points scaled to their metric's range."""
    return metrics.scaled(daily(spark, sf_dir), "metric", "v").select("metric", "day", F.round("scaled", 6).alias("scaled"))


@registry.add("SELECT CAST(ts AS DATE) AS day, count(*) AS runs, round(100.0 * avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM events GROUP BY 1")
def success_rate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of events that are no errors, per day."""
    return opsagg.success_rate(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day"], F.col("event_type") != "error", digits=6)


LAG_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the days between their order and their shipping."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("lag_days", F.datediff(F.to_date("l_shipdate"), "day").cast("long"))


@registry.add(f"SELECT l_orderkey, l_linenumber, lag_days::BIGINT AS late, CASE WHEN lag_days >= 110 THEN 'crit' ELSE 'warn' END AS severity FROM ({LAG_SQL}) WHERE lag_days > 90")
def sla_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shipped later than the threshold, with severity."""
    return opsagg.delays(lags(spark, sf_dir), "lag_days", F.lit(90), critical=110).select("l_orderkey", "l_linenumber", "late", "severity")


@registry.add(f"SELECT o_orderpriority, count(*) AS runs, count_if(lag_days > 90)::BIGINT AS violations, median(lag_days)::DOUBLE AS p50, max(lag_days)::BIGINT AS longest FROM ({LAG_SQL}) GROUP BY 1")
def sla_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, violations and durations per priority."""
    return opsagg.sla_history(lags(spark, sf_dir), ["o_orderpriority"], "lag_days", 90)


@registry.add(f"SELECT day, count_if(lag_days > 90)::BIGINT AS violations FROM ({LAG_SQL}) GROUP BY 1")
def sla_violations_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by order day."""
    return lags(spark, sf_dir).groupBy("day").agg(F.count_if(F.col("lag_days") > 90).alias("violations"))


@registry.add("""
WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 23 * 3600 WHEN 'click' THEN 1800 WHEN 'view' THEN 12 * 3600 ELSE 6 * 3600 END AS sod FROM events),
c AS (SELECT event_id, ts, k, date_trunc('day', ts) + to_seconds(sod) + to_days(k) AS cand FROM e, (VALUES (-1), (0), (1)) t(k)),
r AS (SELECT event_id, cand, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch(ts) - epoch(cand)), k) AS rn, epoch(ts) - epoch(cand) AS off FROM c)
SELECT event_id, CAST(cand AS DATE) AS planned_day, CAST(round(off) AS BIGINT) AS off_sec FROM r WHERE rn = 1""")
def nearest_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned run nearest to each event, of the day before, the day and the day after."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    sod = F.when(F.col("event_type") == "error", 23 * 3600).when(F.col("event_type") == "click", 1800).when(F.col("event_type") == "view", 12 * 3600).otherwise(6 * 3600)
    planned = opsagg.nearest_planned(e, "ts", sod)
    return planned.select("event_id", F.to_date("planned").alias("planned_day"), F.round("off_sec").cast("long").alias("off_sec"))


LOADS_SQL = "SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


@registry.add(f"""WITH d AS ({LOADS_SQL}), m AS (SELECT *, median(v) OVER (PARTITION BY k) AS med FROM d)
SELECT k, count(*) AS days, round(max(med), 4) AS median_v, min(v) AS low, max(v) AS high, max_by(v, day) AS latest, max(day) AS latest_day, count_if(v < 0.5 * med)::BIGINT AS drops FROM m GROUP BY k""")
def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily load of each supplier: range, latest, and drops below half of the median."""
    li = table(spark, sf_dir, "lineitem")
    loads = li.groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))
    return opsagg.load_stats(loads, "k", "day", "v").withColumn("median_v", F.round("median_v", 4))


@registry.add("SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_quantity) AS median_v, min(l_quantity) AS low, max(l_quantity) AS high, max_by(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS latest FROM lineitem GROUP BY 1, 2")
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, median and latest value per flag and status."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.median("l_quantity").alias("median_v"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("latest"))


@registry.add("SELECT CAST(ts AS DATE) AS day, count_if(event_type = 'click')::BIGINT AS clicks, count_if(event_type = 'view')::BIGINT AS views, round(100.0::DOUBLE * count_if(event_type = 'click') / nullif(count_if(event_type = 'view'), 0), 3) AS ctr FROM events GROUP BY 1")
def ctr_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks per hundred views, per day."""
    return opsagg.click_rate(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day"], "event_type")


@registry.add("""SELECT dayofweek(ts)::BIGINT AS weekday, count_if(event_type = 'view')::BIGINT AS n_view, count_if(event_type = 'click')::BIGINT AS n_click, count_if(event_type = 'signup')::BIGINT AS n_signup, count_if(event_type = 'purchase')::BIGINT AS n_purchase,
round(count_if(event_type = 'purchase')::DOUBLE / nullif(count_if(event_type = 'view'), 0), 4) AS conversion FROM events GROUP BY 1""")
def funnel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each step by weekday (Sunday 0), and purchases per view."""
    e = table(spark, sf_dir, "events").withColumn("weekday", (F.dayofweek("ts") - 1).cast("long"))
    return opsagg.funnel(e, ["weekday"], "event_type", ["view", "click", "signup", "purchase"]).withColumn("conversion", F.round("conversion", 4))


@registry.add("""WITH defs AS (SELECT DISTINCT p_brand, p_type, p_size FROM part),
used AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT p_brand, p_type, p_size, coalesce(n, 0) AS n, n IS NULL AS gap FROM defs LEFT JOIN used USING (p_brand, p_type, p_size)""")
def definition_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions (brand, type, size) with the returned items seen of them; gap if none."""
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    keys = ["p_brand", "p_type", "p_size"]
    return opsagg.coverage(part.select(*keys).distinct(), part.join(li, F.col("l_partkey") == F.col("p_partkey")), keys)


@registry.add("SELECT count(*) AS orders, count_if(o_orderstatus = 'F')::BIGINT AS finished, count_if(o_orderstatus = 'O')::BIGINT AS open, count_if(o_totalprice > 300000)::BIGINT AS large, count_if(o_orderpriority LIKE '1-%')::BIGINT AS urgent, count(DISTINCT o_custkey) AS customers FROM orders")
def kpi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of conditional counts in one pass."""
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 300000).alias("large"), F.count_if(F.col("o_orderpriority").like("1-%")).alias("urgent"), F.count_distinct("o_custkey").alias("customers"))


@registry.add("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events)
SELECT 'success_rate' AS metric, day, round(100.0 * avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END), 4) AS v FROM d GROUP BY day UNION ALL
SELECT 'errors', day, count_if(event_type = 'error')::DOUBLE FROM d GROUP BY day UNION ALL
SELECT 'ctr', day, round(100.0::DOUBLE * count_if(event_type = 'click') / nullif(count_if(event_type = 'view'), 0), 4) FROM d GROUP BY day UNION ALL
SELECT 'revenue', day, round(sum(value) FILTER (event_type = 'purchase'), 4) FROM d GROUP BY day""")
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four daily metrics in long form, out of one aggregation."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return opsagg.daily_metrics(e, "day", "event_type", "value").withColumn("v", F.round("v", 4))


@registry.add("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, lang AS majority, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1""")
def mode_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language of each source, ties to the least."""
    return opsagg.majority(table(spark, sf_dir, "documents"), ["source"], "lang")


@registry.add("""WITH c AS (SELECT CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS facet, count(*) AS n FROM documents GROUP BY 1)
SELECT facet, n FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language with a bucket for the rest and a total."""
    return opsagg.facets(table(spark, sf_dir, "documents"), "lang", ["en", "de"])


@registry.add("""SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS amount,
round(coalesce(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS offset_v,
round(l_extendedprice / nullif(sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 0), 6) AS share FROM lineitem""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waterfall of an order's lines: what went before, and the share of the whole."""
    w = opsagg.waterfall(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_extendedprice")
    return w.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("amount"), F.round("offset", 2).alias("offset_v"), F.round("share", 6).alias("share"))


@registry.add("SELECT conv_id, turn, role, next_role, next_turn FROM (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next_turn IS NOT NULL")
def lead_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of each conversation."""
    return opsagg.consecutive(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], {"role": "next_role", "turn": "next_turn"})


@registry.add("""WITH a AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, o_custkey FROM orders)
SELECT o_custkey, count(*) AS n_last, string_agg(o_orderstatus, '' ORDER BY rn) AS statuses FROM a WHERE rn <= 5 GROUP BY 1""")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of each customer's last five orders, newest first."""
    o = opsagg.last_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    s = F.array_sort(F.collect_list(F.struct("nth", "o_orderstatus")))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_last"), F.array_join(F.transform(s, lambda x: x["o_orderstatus"]), "").alias("statuses"))
