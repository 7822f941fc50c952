"""Jobs with their logs, and versions out of replayed history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import history, jobs
from tidewright.plans.registry import Registry
from tidewright.session import scratch, table

registry = Registry()


def _documents(orders: DataFrame) -> DataFrame:
    """A document per customer, about its orders."""
    body = F.concat(F.lit("orders "), F.count("*").cast("string"), F.lit(", last "), F.max("o_orderkey").cast("string"))
    return orders.groupBy("o_custkey").agg(body.alias("body")).withColumn("hash", history.content_hash("body"))


KIND = "o_custkey long, body string, hash string"


@registry.add("""WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c, (SELECT count(DISTINCT o_custkey) FROM orders) AS d),
r AS (SELECT * FROM (VALUES (1), (2)) v(run))
SELECT run, 1 AS seq, 'collect' AS stage, 'orders' AS target, 'success' AS status, o AS n FROM n, r UNION ALL SELECT run, 2, 'collect', 'customer', 'success', c FROM n, r
UNION ALL SELECT run, 3, 'collect', 'absent', 'failed', NULL FROM r UNION ALL SELECT run, 4, 'store', 'documents', 'success', CASE run WHEN 1 THEN d ELSE 0 END FROM n, r UNION ALL SELECT run, 5, 'run', '', 'partial', NULL FROM r""")
def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step log of a job that is run twice: the second run stores nothing; a source that is not
    there makes both partial."""
    folder = scratch(spark, "job")
    log, store = jobs.Log(spark, f"{folder}/log"), jobs.Store(spark, f"{folder}/store", KIND)

    def counted(name):
        return lambda: {"n": table(spark, sf_dir, name).count()}

    def stored(moment):
        done = store.put(_documents(table(spark, sf_dir, "orders")), "o_custkey", moment)
        return {"n": done["created"] + done["updated"]}

    runs = []
    for moment in ("2024-01-01", "2024-01-02"):
        steps = [jobs.Step("collect", x, counted(x), soft=True) for x in ("orders", "customer", "absent")]
        runs.append(jobs.run(log, "full-sync", [*steps, jobs.Step("store", "documents", lambda m=moment: stored(m))])["run_id"])
    which = F.element_at(F.create_map(*(x for k, r in enumerate(runs, 1) for x in (F.lit(r), F.lit(k)))), F.col("run_id"))
    steps = log.steps().select(which.alias("run"), "seq", "stage", "target", "status", F.element_at("stats", "n").alias("n"))
    ends = log.runs().select(which.alias("run"), F.lit(5).alias("seq"), F.lit("run").alias("stage"), F.lit("").alias("target"), "status", F.lit(None).cast("long").alias("n"))
    return steps.unionByName(ends)


MOMENTS = ["1996-01-01", "1997-07-01", "1999-01-01", "2003-01-01"]


@registry.add(f"""WITH m AS (SELECT moment FROM (VALUES {", ".join(f"('{m}')" for m in MOMENTS)}) v(moment)),
d AS (SELECT moment, o_custkey, sha256('orders ' || count(*) || ', last ' || max(o_orderkey)) AS hash FROM m JOIN orders ON o_orderdate <= moment::TIMESTAMP GROUP BY ALL),
c AS (SELECT *, hash IS DISTINCT FROM lag(hash) OVER (PARTITION BY o_custkey ORDER BY moment) AS changed FROM d)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY moment)::INTEGER AS version, hash, moment AS "at" FROM c WHERE changed""")
def replayed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of customers' documents, out of orders as they were at four moments."""
    folder = scratch(spark, "replay")
    store, orders = jobs.Store(spark, f"{folder}/store", KIND), table(spark, sf_dir, "orders")

    def steps_at(moment):
        return [jobs.Step("store", "documents", lambda: store.put(_documents(jobs.as_of(orders, "o_orderdate", moment)), "o_custkey", moment))]

    jobs.replay(jobs.Log(spark, f"{folder}/log"), "history", MOMENTS, steps_at)
    return store.versions().select("o_custkey", "version", "hash", "at")
