"""Change capture, versions, blocks and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import history
from tidewright.plans.registry import Registry
from tidewright.session import table

registry = Registry()


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as they are, and a made-up snapshot before: some keys absent, some prices other,
    some keys that have gone since."""
    now = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    h = lambda df: df.withColumn("hash", history.content_hash(F.concat_ws("|", F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "o_orderstatus")))
    old = now.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    gone = now.where("o_orderkey % 50 = 1").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return h(old.unionByName(gone)), h(now)


SNAPSHOT_SQL = """WITH n AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM n WHERE o_orderkey % 10 <> 0 UNION ALL SELECT -o_orderkey - 1, o_totalprice, o_orderstatus FROM n WHERE o_orderkey % 50 = 1),
nh AS (SELECT o_orderkey, sha256(o_totalprice::DECIMAL(18,2)::VARCHAR || '|' || o_orderstatus) AS hash FROM n), oh AS (SELECT o_orderkey, sha256(o_totalprice::DECIMAL(18,2)::VARCHAR || '|' || o_orderstatus) AS hash FROM o)"""


@registry.add(SNAPSHOT_SQL + """ SELECT coalesce(nh.o_orderkey, oh.o_orderkey) AS o_orderkey, CASE WHEN oh.hash IS NULL THEN 'new' WHEN nh.hash IS NULL THEN 'gone' WHEN oh.hash = nh.hash THEN 'unchanged' ELSE 'changed' END AS status FROM oh FULL JOIN nh ON oh.o_orderkey = nh.o_orderkey""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots of orders."""
    return history.snapshot_diff(*snapshots(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "status")


@registry.add(SNAPSHOT_SQL + " SELECT o_orderkey, hash FROM nh EXCEPT SELECT o_orderkey, hash FROM oh")
def new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that the version store does not have yet."""
    old, now = snapshots(spark, sf_dir)
    return history.new_versions(old, now, ["o_orderkey"]).select("o_orderkey", "hash")


@registry.add("SELECT doc_id, sha256(text) AS hash, sha256(text)[1:16] AS short FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", history.content_hash("text").alias("hash"), history.content_hash("text", length=16).alias("short"))


@registry.add("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY text")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, by hash, and how many there are."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", history.content_hash("text").alias("hash"))
    n = d.groupBy("hash").agg(F.count("*").alias("n"))
    return history.keep_first(d, ["hash"], ["doc_id"]).join(n, "hash").select("hash", "doc_id", "source", "n")


VERSIONS_SQL = "v AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, row_number() OVER w AS version, lag(o_totalprice) OVER w AS prev_content, lead(o_orderkey) OVER w IS NULL AS is_last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the versions of their customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return history.with_versions(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@registry.add(f"WITH {VERSIONS_SQL} SELECT o_custkey, o_orderkey, version, o_totalprice FROM v WHERE is_last")
def versions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of each customer."""
    return history.current(versions(spark, sf_dir), "o_custkey").select("o_custkey", "o_orderkey", "version", "o_totalprice")


@registry.add(f"WITH {VERSIONS_SQL} SELECT o_custkey, o_orderkey, version, prev_content, round(o_totalprice - prev_content, 2) AS delta FROM v")
def versions_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with the content before it."""
    return versions(spark, sf_dir).select("o_custkey", "o_orderkey", "version", "prev_content", F.round(F.col("o_totalprice") - F.col("prev_content"), 2).alias("delta"))


@registry.add(f"WITH {VERSIONS_SQL} SELECT o_custkey, o_orderkey, version FROM v WHERE is_last ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def recent_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty newest current versions: a report of the top."""
    return history.recent_updates(versions(spark, sf_dir), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 30).select("o_custkey", "o_orderkey", "version")


@registry.add(f"WITH {VERSIONS_SQL} SELECT o_custkey, o_orderkey, version FROM v QUALIFY version > max(version) OVER (PARTITION BY o_custkey) - 3")
def retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three versions of each customer."""
    return history.keep_last(versions(spark, sf_dir), "o_custkey", 3).select("o_custkey", "o_orderkey", "version")


@registry.add(f"WITH {VERSIONS_SQL} SELECT o_custkey, max_by(o_orderkey, version) AS o_orderkey, max(version) AS version FROM v WHERE o_orderstatus NOT IN (SELECT 'F') GROUP BY 1")
def asof_unblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each customer whose content is not blocked."""
    blocked = spark.createDataFrame([("F",)], "o_orderstatus string")
    return history.before_blocked(versions(spark, sf_dir), blocked, "o_custkey", "o_orderstatus", ["version"]).select("o_custkey", "o_orderkey", "version")


@registry.add(f"WITH {VERSIONS_SQL} SELECT o_custkey, version + 1 AS version, CASE WHEN version > 1 THEN prev_content END AS o_totalprice, version = 1 AS deleted FROM v WHERE is_last")
def undo_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that undo the last version of each customer."""
    v = versions(spark, sf_dir)
    return history.undo(v, v, "o_custkey", "o_totalprice").select("o_custkey", "version", "o_totalprice", "deleted")


@registry.add(f"WITH {VERSIONS_SQL} SELECT o_orderkey, o_custkey, version, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY version) AS restores, is_last FROM v")
def undo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What undoing each version would restore."""
    return history.undo_candidates(versions(spark, sf_dir), "o_orderkey", "o_custkey", "o_orderstatus").select("o_orderkey", "o_custkey", "version", "restores", "is_last")


@registry.add("""WITH old AS (SELECT o_custkey, max(o_orderkey) AS k, count(*) AS version FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1), n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT n.o_custkey, CASE WHEN old.k IS NULL THEN 'created' WHEN old.k = n.k THEN 'unchanged' ELSE 'updated' END AS action, coalesce(version, 0) + CASE WHEN old.k = n.k THEN 0 ELSE 1 END AS version FROM n LEFT JOIN old USING (o_custkey)""")
def upsert_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert of each customer's newest order does."""
    o = table(spark, sf_dir, "orders")
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    old = o.where("o_orderkey % 4 <> 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.count("*").alias("version")).select("o_custkey", h.alias("hash"), "version")
    new = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_custkey", h.alias("hash"))
    return history.upsert(old, new, "o_custkey").select("o_custkey", "action", "version")


@registry.add("""SELECT 'orders' AS "table", count(*) AS n FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)""")
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a purge of one customer takes from each table."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return history.purge({"orders": (o, F.col("o_custkey") == 7), "lineitem": (li, F.col("o_custkey") == 7)})[1]


@registry.add("""WITH s AS (SELECT o_custkey AS k, o_orderpriority AS sec, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS body FROM orders GROUP BY ALL), t AS (SELECT o_custkey AS k, o_orderpriority AS sec, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS body FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL)
SELECT k, sec, CASE WHEN t.body IS NULL THEN 'added' WHEN s.body IS NULL THEN 'removed' ELSE 'changed' END AS change FROM t FULL JOIN s USING (k, sec) WHERE t.body IS DISTINCT FROM s.body""")
def section_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections (priorities) of customer pages that changed between two builds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("sec"), "o_orderkey")
    body = lambda df: df.groupBy("k", "sec").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))).alias("body"))
    return history.section_changes(body(o.where("o_orderkey % 5 <> 0")), body(o), "k", "sec", "body")
