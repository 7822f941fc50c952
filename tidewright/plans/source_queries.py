"""Converters, script lineage and readers on texts made of the tables' rows, and the streamed roll-up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import graph
from tidewright.plans.registry import Registry
from tidewright.session import ensure_checkpoint_dir, table
from tidewright.sources import convert, readers, scripts, sinks
from tidewright.streaming import rollup

registry = Registry()


@registry.add("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, (length(html) - length(replace(html, '<li', '')))::BIGINT // 3 AS n_items, length(html)::BIGINT AS n_chars FROM pages")
def html_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, list items and size of each page, by string functions."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), tx.occurrences("html", "<li").alias("n_items"), F.char_length("html").cast("long").alias("n_chars"))


@registry.add()
def html_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown with what was found in them."""
    c = table(spark, sf_dir, "pages").select("page_id", convert.converted(F.col("url"), F.col("html")).alias("c"))
    return c.select("page_id", F.col("c.title").alias("title"), F.char_length("c.markdown").cast("long").alias("n_chars"), F.col("c.stats")["paragraph"].alias("paragraphs"), F.size("c.warnings").alias("n_warnings"))


@registry.add("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'raw.n' || c_nationkey WHEN 'MACHINERY' THEN '' ELSE 'dim.n' || c_nationkey || ',raw.c' || c_custkey END AS reads,
CASE c_mktsegment WHEN 'MACHINERY' THEN '' ELSE 'mart.c' || c_custkey END AS writes FROM customer""")
def sql_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read and written by a SQL text per customer, of one of three forms."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    joined = F.concat(F.lit("INSERT OVERWRITE TABLE mart.c"), k, F.lit(" PARTITION (dt='{{ ds }}') WITH x AS (SELECT * FROM raw.c"), k, F.lit(") SELECT * FROM x JOIN dim.n"), n, F.lit(" i ON x.id = i.id"))
    own = F.concat(F.lit("INSERT INTO mart.c"), k, F.lit(" SELECT * FROM mart.c"), k, F.lit(", raw.n"), n, F.lit(" AS v WHERE a = 'from zzz' -- from nope"))
    sql = F.when(F.col("c_mktsegment") == "BUILDING", own).when(F.col("c_mktsegment") == "MACHINERY", "SELECT 1").otherwise(joined)
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scripts.lineage(sql).alias("l"))
    return s.select("id", F.array_join("l.reads", ",").alias("reads"), F.array_join("l.writes", ",").alias("writes"))


@registry.add("""SELECT 'mart.s' || s_suppkey AS name, 'of nation ' || s_nationkey AS comment, 2::BIGINT AS line, 'id:BIGINT,price:DECIMAL(12,' || (s_nationkey % 3) || '),tags:ARRAY<STRING>' AS columns, 'dt,h' || s_nationkey AS partitions FROM supplier
UNION ALL SELECT 'u' || s_suppkey, NULL, 8, 'a' || s_nationkey || ':INT', '' FROM supplier""")
def ddl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables defined by a DDL text per supplier, two in each."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    ddl = F.concat(F.lit("-- s\nCREATE TABLE IF NOT EXISTS mart.s"), k, F.lit(" (\n id BIGINT COMMENT 'key, first',\n price DECIMAL(12,"), (F.col("s_nationkey") % 3).cast("string"), F.lit("),\n tags ARRAY<STRING>\n) COMMENT 'of nation "), n, F.lit("'\nPARTITIONED BY (dt STRING, h"), n, F.lit(" INT);\nCREATE EXTERNAL TABLE u"), k, F.lit(" (a"), n, F.lit(" INT);"))
    d = table(spark, sf_dir, "supplier").select(F.inline(scripts.definitions(ddl)))
    return d.select("name", "comment", "line", F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"])), ",").alias("columns"), F.array_join("partitions", ",").alias("partitions"))


@registry.add("""WITH s AS (SELECT 'dag:s' || s_suppkey AS dag, s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_acctbal >= 0)
SELECT dag AS src, 'reads' AS rel, 'table:raw.n' || n AS dst FROM s UNION ALL SELECT dag, 'writes', 'table:mart.s' || k FROM s UNION ALL SELECT dag, 'depends_on', 'dag:n' || n FROM s UNION ALL SELECT dag, 'builds', 'index:i' || n FROM s""")
def script_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges out of a DAG script per supplier; the texts of suppliers in debt are no DAG and give
    none."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    code = F.concat(F.lit('from airflow import DAG\nwith DAG("s'), k, F.lit('", schedule="0 3 * * *", tags=["mart"], default_args={"owner": "data", "retries": 2}) as dag:\n    w = ExternalTaskSensor(task_id="wait", external_dag_id="n'), n, F.lit('")\n    b = SparkSqlOperator(task_id="build", sql="INSERT INTO mart.s'), k, F.lit(" SELECT * FROM raw.n"), n, F.lit('")\n    x = IndexOperator(task_id="index", index_family="i'), n, F.lit('", source_table="mart.s'), k, F.lit('")\n    w >> b >> [x]\n'))
    none = F.when(F.col("s_nationkey") % 3 == 0, "not python (").when(F.col("s_nationkey") % 3 == 1, "x = 1")
    s = table(spark, sf_dir, "supplier").select(scripts.dags(F.when(F.col("s_acctbal") >= 0, code).otherwise(none)).alias("d")).where("d IS NOT NULL").select("d.*")
    return graph.distinct_edges(scripts.lineage_edges(s)).select("src", "rel", "dst")


@registry.add("""SELECT 'w' || o_orderkey AS workflow_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS run_status, 'a "' || o_orderpriority || '", b' AS rows, NULL::VARCHAR AS gone, 'c' || o_custkey || '.csv' AS _file, 1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS _line FROM orders""")
def csv_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV text per customer, its orders, with file and line."""
    line = F.concat(F.lit("w"), F.col("o_orderkey").cast("string"), F.lit(","), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")), F.lit(',"a ""'), "o_orderpriority", F.lit('"", b"\n'))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda r: r["line"]), "")
    f = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("rows"))
    f = f.select(F.concat(F.lit("s3://b/ops/c"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), F.concat(F.lit("﻿workflow_id,run_status,rows\n"), "rows").alias("text"))
    return readers.csv_rows(f, ["workflow_id", "run_status", "rows", "gone"]).drop("_raw")


@registry.add("""SELECT 'c' || c_custkey AS dag_id, c_acctbal < 0 AS is_paused, c_mktsegment || ',n' || c_nationkey AS tags, count(o_orderkey) AS n_runs, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_state FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def scheduler_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAGs of a scheduler snapshot per customer, whose orders are its runs, with the newest one."""
    run = F.struct("o_orderdate", "o_orderkey", F.struct(F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("string").alias("start_date")).alias("run"))
    newest = F.transform(F.sort_array(F.collect_list(run), False), lambda r: r["run"])
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(newest.alias("runs"))
    c = table(spark, sf_dir, "customer").join(runs, "c_custkey", "left").withColumn("dag_id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    tags = F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name")))
    dag = F.struct("dag_id", (F.col("c_acctbal") < 0).alias("is_paused"), tags.alias("tags"))
    snapshot = F.to_json(F.struct(F.lit("x").alias("fetched_at"), F.array(dag).alias("dags"), F.when(F.col("runs").isNotNull(), F.create_map("dag_id", "runs")).alias("dag_runs")))
    f = c.select(F.concat("dag_id", F.lit(".json")).alias("path"), snapshot.alias("text"))
    return readers.scheduler_dags(f).select("dag_id", "is_paused", F.array_join("tags", ",").alias("tags"), F.size("runs").cast("long").alias("n_runs"), F.get("runs", F.lit(0))["state"].alias("last_state"))


@registry.add("""SELECT c_custkey, '# ' || c_name || chr(10) || CASE WHEN count(o_orderkey) > 0 THEN chr(10) || '## Orders' || chr(10) || string_agg('- ' || o_orderkey, chr(10) ORDER BY o_orderkey) || chr(10) ELSE '' END AS page FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def page_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown page per customer with its orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")
    return c.select("c_custkey", sinks.page(F.col("c_name"), {"Orders": F.coalesce("orders", F.array().cast("array<bigint>"))}).alias("page"))


@registry.add("SELECT event_type AS metric, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def stream_metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily roll-up as a stream over files that ends when all are read; late rows are
    allowed for as long as the table is."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = rollup.event_stream(spark, sf_dir, schema, glob="events.parquet")
    done = rollup.metric_rollup(stream, "ts", "event_type", "value", late="60 days")
    rollup.run_complete(done, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("metric", F.to_date("start").alias("day"), "n", F.round("v", 4).alias("v"))


@registry.add("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, k""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events with no pause of twelve hours."""
    return rollup.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "12 hours").select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))
