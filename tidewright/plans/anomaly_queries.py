"""Findings by rule, their groups, and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import anomaly
from tidewright.plans.registry import Registry
from tidewright.session import cut, table

registry = Registry()


@registry.add("""WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT l_orderkey, count(*) AS n_errors, string_agg('part ' || l_partkey, '; ' ORDER BY l_linenumber, 'part ' || l_partkey) AS errors FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, o_custkey, coalesce(n_errors, 0) AS n_errors, errors FROM f LEFT JOIN e ON l_orderkey = o_orderkey""")
def failed_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as failed runs, with their returned items as errors in order."""
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    errors = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.concat(F.lit("part "), F.col("l_partkey")).alias("message"))
    return anomaly.failed_with_errors(runs, errors, ["o_orderkey"], "message", ["l_linenumber"])


@registry.add("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items of orders that are not finished."""
    errors = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return anomaly.orphan_errors(errors, failed, ["l_orderkey"])


@registry.add("""WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), d AS (SELECT DISTINCT day FROM s),
e AS (SELECT user_id FROM s GROUP BY 1 HAVING count(*) >= 0.8 * (SELECT count(*) FROM d))
SELECT user_id, day FROM e, d EXCEPT SELECT user_id, day FROM s""")
def run_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without an event of users that have events on most days."""
    return anomaly.missing_runs(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@registry.add("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT *, median(n) OVER () AS median_v FROM d)
SELECT day, n, median_v FROM m WHERE median_v > 0 AND n < 0.5 * median_v""")
def volume_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with less than half of the median number of orders."""
    n = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return anomaly.volume_drop(n, [], "n")


@registry.add("""WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL), m AS (SELECT *, median(v) OVER (PARTITION BY o_orderpriority) AS median_v FROM d)
SELECT o_orderpriority, day, round(v, 4) AS v, round(median_v, 4) AS median_v FROM m WHERE median_v > 0 AND v < 0.5 * median_v""")
def volume_drop_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with less than half of the median order value, per priority."""
    v = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return anomaly.volume_drop(v, ["o_orderpriority"], "v").withColumns({c: F.round(c, 4) for c in ("v", "median_v")})


@registry.add("""WITH m AS (SELECT event_type, median(value) AS median_v FROM events GROUP BY 1),
d AS (SELECT event_type, median(abs(value - median_v)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, event_type, value, round(median_v, 6) AS median_v, round(CASE WHEN mad = 0 THEN 1 ELSE mad END, 6) AS mad FROM events JOIN m USING (event_type) JOIN d USING (event_type)
WHERE (median_v > 0 AND abs(value - median_v) > 5 * CASE WHEN mad = 0 THEN 1 ELSE mad END AND abs(value - median_v) > 0.3 * median_v) OR (median_v = 0 AND value > 0)""")
def quality_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values far from their type's median, by median absolute deviation."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return anomaly.quality_outlier(e, ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("median_v", "mad")}).select("event_id", "event_type", "value", "median_v", "mad")


@registry.add("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), m AS (SELECT *, median(n) OVER () AS median_v FROM d)
SELECT day, n, median_v FROM m WHERE median_v > 0 AND n < 0.9 * median_v""")
def behavior_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with clearly fewer views than the median."""
    n = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return anomaly.volume_drop(n, [], "n", 0.9)


#: Days from order to shipment that are allowed, and from which a delay is critical.
ALLOWED_DAYS, CRITICAL_DAYS = 90, 1200

FINDINGS_SQL = f"""
WITH RECURSIVE o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, 'lineitem:' || l_orderkey || '/' || l_linenumber AS src FROM lineitem WHERE l_returnflag = 'R'),
re AS (SELECT l_orderkey, count(*) AS n, string_agg(src, ',' ORDER BY l_linenumber, l_partkey) AS srcs FROM r GROUP BY 1),
f1 AS (SELECT 'workflow_failed' AS rule, 'crit' AS severity, day, ['order:' || o_orderkey] AS entities, 'order ' || o_orderkey || ' failed with ' || coalesce(n, 0) || ' errors' AS summary, 'orders:' || o_orderkey || coalesce(',' || srcs, '') AS sources FROM o LEFT JOIN re ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
f1b AS (SELECT 'workflow_failed' AS rule, 'warn' AS severity, day, ['order:' || l_orderkey, 'part:' || l_partkey] AS entities, 'part ' || l_partkey || ' returned' AS summary, src AS sources FROM r JOIN o ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'),
l AS (SELECT l_orderkey, l_suppkey, max(datediff('day', day, CAST(l_shipdate AS DATE))) AS lag, max(CAST(l_shipdate AS DATE)) AS day, string_agg('lineitem:' || l_orderkey || '/' || l_linenumber, ',' ORDER BY l_linenumber) AS srcs FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY ALL),
f2 AS (SELECT 'sla_delay' AS rule, CASE WHEN lag >= {CRITICAL_DAYS} THEN 'crit' ELSE 'warn' END AS severity, day, ['order:' || l_orderkey, 'supplier:' || l_suppkey] AS entities, 'late order ' || l_orderkey AS summary, 'orders:' || l_orderkey || ',' || srcs AS sources FROM l WHERE lag > {ALLOWED_DAYS}),
s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), sd AS (SELECT DISTINCT day FROM s),
se AS (SELECT user_id FROM s GROUP BY 1 HAVING count(*) >= 0.8 * (SELECT count(*) FROM sd)),
f3 AS (SELECT 'run_missing' AS rule, 'warn' AS severity, day, ['user:' || user_id] AS entities, 'no event of user ' || user_id AS summary, '' AS sources FROM (SELECT user_id, day FROM se, sd EXCEPT SELECT user_id, day FROM s)),
v AS (SELECT o_orderpriority, day, sum(o_totalprice) AS v FROM o GROUP BY ALL), vm AS (SELECT *, median(v) OVER (PARTITION BY o_orderpriority) AS m FROM v),
f4 AS (SELECT 'volume_drop' AS rule, 'crit' AS severity, day, ['priority:' || o_orderpriority] AS entities, 'volume ' || o_orderpriority AS summary, 'orders:' || o_orderpriority || '/' || strftime(day, '%Y-%m-%d') AS sources FROM vm WHERE m > 0 AND v < 0.5 * m),
qm AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), qd AS (SELECT event_type, median(abs(value - m)) AS d FROM events JOIN qm USING (event_type) GROUP BY 1),
f5 AS (SELECT 'quality_outlier' AS rule, 'warn' AS severity, CAST(ts AS DATE) AS day, ['event_type:' || event_type, 'event:' || event_id] AS entities, 'outlier of ' || event_type AS summary, 'events:' || event_id AS sources FROM events JOIN qm USING (event_type) JOIN qd USING (event_type)
  WHERE (m > 0 AND abs(value - m) > 5 * CASE WHEN d = 0 THEN 1 ELSE d END AND abs(value - m) > 0.3 * m) OR (m = 0 AND value > 0)),
b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), bm AS (SELECT *, median(n) OVER () AS m FROM b),
f6 AS (SELECT 'behavior_drop' AS rule, 'crit' AS severity, day, ['event_type:view'] AS entities, 'few views' AS summary, 'events:view/' || strftime(day, '%Y-%m-%d') AS sources FROM bm WHERE m > 0 AND n < 0.6 * m),
f AS (SELECT *, day::TIMESTAMP AS "at", ('0x' || substr(sha256(rule || '|' || strftime(day, '%Y-%m-%d') || '|' || array_to_string(entities, ',')), 1, 15))::BIGINT AS fid
  FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f1b UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f5 UNION ALL SELECT * FROM f6))"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of six rules, each with the source rows that it cites: failed orders with their
    returned items and returned items of other orders, late orders, users' missing days, volume
    drops, outlying events, days of few views."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    li = table(spark, sf_dir, "lineitem")
    events = table(spark, sf_dir, "events")
    key, text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")), F.concat
    line = text(F.lit("lineitem:"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    day_of = lambda prefix, c: text(F.lit(prefix), *([F.col(c), F.lit("/")] if c else []), F.date_format("day", "yyyy-MM-dd"))

    ordered = o.select(F.col("o_orderkey").alias("l_orderkey"), "day", "o_orderstatus")
    returned = li.where("l_returnflag = 'R'")
    failed = ordered.where("o_orderstatus = 'F'")
    runs = anomaly.failed_with_errors(failed, returned.select("l_orderkey", "l_linenumber", "l_partkey", line.alias("src")), ["l_orderkey"], "src", ["l_linenumber", "l_partkey"])
    own = F.array(key("orders:", "l_orderkey"))
    cited = F.when(F.col("errors").isNull(), own).otherwise(F.concat(own, F.split("errors", "; ")))
    summary = text(key("order ", "l_orderkey"), key(" failed with ", "n_errors"), F.lit(" errors"))
    r1 = anomaly.finding(runs, "workflow_failed", "crit", F.col("day"), F.col("day"), [key("order:", "l_orderkey")], summary, cited, n_errors=F.col("n_errors"))
    loose = anomaly.orphan_errors(returned.select("l_orderkey", "l_partkey", line.alias("src")), failed, ["l_orderkey"]).join(ordered.where("o_orderstatus IS NOT NULL"), "l_orderkey")
    r1b = anomaly.finding(loose, "workflow_failed", "warn", F.col("day"), F.col("day"), [key("order:", "l_orderkey"), key("part:", "l_partkey")], text(key("part ", "l_partkey"), F.lit(" returned")), F.array("src"))

    ship = F.to_date("l_shipdate")
    late = li.join(ordered.select("l_orderkey", F.col("day").alias("ordered")), "l_orderkey")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("src")))), lambda x: x["src"])
    late = late.groupBy("l_orderkey", "l_suppkey").agg(F.max(F.datediff(ship, "ordered")).alias("lag"), F.max(ship).alias("day"), in_order.alias("srcs")).where(F.col("lag") > ALLOWED_DAYS)
    r2 = anomaly.finding(late, "sla_delay", F.when(F.col("lag") >= CRITICAL_DAYS, "crit").otherwise("warn"), F.col("day"), F.col("day"), [key("order:", "l_orderkey"), key("supplier:", "l_suppkey")], key("late order ", "l_orderkey"), F.concat(F.array(key("orders:", "l_orderkey")), "srcs"), lag=F.col("lag"))

    gone = anomaly.missing_runs(events.select("user_id", F.to_date("ts").alias("day")), "user_id", "day")
    r3 = anomaly.finding(gone, "run_missing", "warn", F.col("day"), F.col("day"), [key("user:", "user_id")], key("no event of user ", "user_id"))

    drops = anomaly.volume_drop(o.groupBy("o_orderpriority", "day").agg(F.sum("o_totalprice").alias("v")), ["o_orderpriority"], "v", 0.5)
    r4 = anomaly.finding(drops, "volume_drop", "crit", F.col("day"), F.col("day"), [key("priority:", "o_orderpriority")], key("volume ", "o_orderpriority"), F.array(day_of("orders:", "o_orderpriority")), ratio=F.round(F.col("v") / F.col("median_v"), 3))

    odd = anomaly.quality_outlier(events.select("event_id", "event_type", "value", F.to_date("ts").alias("day")), ["event_type"], "value")
    r5 = anomaly.finding(odd, "quality_outlier", "warn", F.col("day"), F.col("day"), [key("event_type:", "event_type"), key("event:", "event_id")], key("outlier of ", "event_type"), F.array(key("events:", "event_id")), value=F.col("value"), median=F.col("median_v"))

    views = events.where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    few = anomaly.volume_drop(views, [], "n", 0.6)
    r6 = anomaly.finding(few, "behavior_drop", "crit", F.col("day"), F.col("day"), [F.lit("event_type:view")], F.lit("few views"), F.array(day_of("events:view/", None)), ratio=F.round(F.col("n") / F.col("median_v"), 3))
    out = r1
    for r in (r1b, r2, r3, r4, r5, r6):
        out = out.unionByName(r)
    return out


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings with fid, written once: their links and their groups are both made of them."""
    return cut(findings(spark, sf_dir).withColumn("fid", anomaly.finding_id()))


@registry.add(FINDINGS_SQL + """SELECT rule, severity, day, array_to_string(entities, ',') AS entities, summary, sources FROM f""")
def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of six rules in one schema, with the rows they cite."""
    return findings(spark, sf_dir).select("rule", "severity", "day", F.array_join("entities", ",").alias("entities"), "summary", F.array_join("sources", ",").alias("sources"))


GROUPED_SQL = FINDINGS_SQL + """,
x AS (SELECT DISTINCT fid, day, unnest(entities) AS e FROM f),
hub AS (SELECT e, day, min(fid) AS h FROM x GROUP BY ALL),
links AS (SELECT fid AS a, h AS b FROM x JOIN hub USING (e, day) UNION SELECT p.h, q.h FROM hub p JOIN hub q ON p.e = q.e AND q.day = p.day + 1),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
g(fid, component) USING KEY (fid) AS (SELECT DISTINCT fid, fid FROM f UNION SELECT w.b, min(r.component) FROM g r JOIN ways w ON w.a = r.fid JOIN recurring.g k ON k.fid = w.b WHERE r.component < k.component GROUP BY w.b)"""


@registry.add(GROUPED_SQL + " SELECT f.fid, rule, day, component FROM f JOIN g USING (fid)")
def findings_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the group that shared entities on close days make."""
    return anomaly.group_findings(numbered(spark, sf_dir)).select("fid", "rule", "day", "component")


@registry.add(GROUPED_SQL + """,
p AS (SELECT component, bool_and(rule = 'sla_delay' AND severity <> 'crit') AS small, bool_or(severity = 'crit') AS crit, count(*) AS n_findings, min(day) AS first_day, max(day) AS last_day,
  arg_min(summary, (severity <> 'crit', "at", fid)) AS title, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM f JOIN g USING (fid) GROUP BY 1),
q AS (SELECT component, string_agg(DISTINCT e, ',' ORDER BY e) AS entities FROM x JOIN g USING (fid) GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY first_day ORDER BY component) AS nth FROM p WHERE NOT small)
SELECT component, 'INC-' || strftime(first_day, '%m%d') || CASE WHEN nth = 1 THEN '' WHEN nth <= 26 THEN chr((nth + 96)::INT) ELSE '-' || nth END AS key, CASE WHEN crit THEN 'P2' ELSE 'P3' END AS priority, n_findings, first_day, last_day, title, rules, entities
FROM n JOIN q USING (component)""")
def incident_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents out of grouped findings; groups of mere delay warnings are left out."""
    return anomaly.incidents(anomaly.group_findings(numbered(spark, sf_dir)))
