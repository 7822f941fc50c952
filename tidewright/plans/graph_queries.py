"""Edges, impact walks, shared assets and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import graph
from tidewright.plans.registry import Registry
from tidewright.session import table

registry = Registry()

EDGES_SQL = """
e AS (SELECT 'region:' || n_regionkey AS src, 'writes' AS rel, 'nation:' || n_nationkey AS dst, 'geo' AS source FROM nation UNION ALL
SELECT 'customer:' || c_custkey, 'reads', 'nation:' || c_nationkey, 'crm' FROM customer UNION ALL
SELECT 'supplier:' || s_suppkey, 'depends_on', 'nation:' || s_nationkey, 'scm' FROM supplier UNION ALL
SELECT 'customer:' || o_custkey, 'builds', 'priority:' || o_orderpriority, 'sales' FROM orders),
d AS (SELECT src, rel, dst, min(source) AS source FROM e GROUP BY ALL),
f AS (SELECT a, b, max(label) AS label FROM (
  SELECT src AS a, dst AS b, rel AS label FROM d WHERE rel IN ('writes', 'builds', 'swaps') UNION ALL
  SELECT dst, src, CASE rel WHEN 'reads' THEN 'read by' WHEN 'alias_of' THEN 'served as' ELSE 'triggers' END FROM d WHERE rel IN ('reads', 'alias_of', 'depends_on')) GROUP BY ALL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    n = graph.edges_of(t("nation"), key("region", "n_regionkey"), "writes", key("nation", "n_nationkey"), "geo")
    c = graph.edges_of(t("customer"), key("customer", "c_custkey"), "reads", key("nation", "c_nationkey"), "crm")
    s = graph.edges_of(t("supplier"), key("supplier", "s_suppkey"), "depends_on", key("nation", "s_nationkey"), "scm")
    o = graph.edges_of(t("orders"), key("customer", "o_custkey"), "builds", key("priority", "o_orderpriority"), "sales")
    return graph.distinct_edges(n.unionByName(c).unionByName(s).unionByName(o))


@registry.add(f"WITH {EDGES_SQL} SELECT a, b, label FROM f")
def edge_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in the direction of impact."""
    return graph.flow(edges(spark, sf_dir))


WALK_SQL = """WITH RECURSIVE {edges},
w AS (SELECT '{start}' AS id, 0 AS distance UNION SELECT {to}, distance + 1 FROM w JOIN f ON {at} = id WHERE distance < 3),
m AS (SELECT id, min(distance) AS distance FROM w GROUP BY 1),
v AS (SELECT m.id, m.distance, min({at}) AS via FROM m JOIN f ON {to} = m.id JOIN m p ON p.id = {at} AND p.distance = m.distance - 1 GROUP BY ALL)
SELECT '{start}' AS start, id, distance, via FROM v WHERE distance > 0"""


def _walk(spark: SparkSession, sf_dir: str, start: str, up: bool) -> DataFrame:
    starts = spark.createDataFrame([(start,)], "id string")
    return graph.walk(graph.flow(edges(spark, sf_dir)), starts, 3, up).select("start", "id", "distance", "via")


@registry.add(WALK_SQL.format(edges=EDGES_SQL, start="region:1", to="b", at="a"))
def downstream_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a region reaches in three steps."""
    return _walk(spark, sf_dir, "region:1", False)


@registry.add(WALK_SQL.format(edges=EDGES_SQL, start="priority:1-URGENT", to="a", at="b"))
def upstream_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches a priority in three steps."""
    return _walk(spark, sf_dir, "priority:1-URGENT", True)


@registry.add(f"WITH {EDGES_SQL} SELECT src, rel, dst, source FROM d WHERE src = 'nation:3' OR dst = 'nation:3'")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one nation."""
    return graph.neighbors(edges(spark, sf_dir), "nation:3").select("src", "rel", "dst", "source")


@registry.add(f"""WITH {EDGES_SQL}, n AS (SELECT 'nation:3' AS id UNION SELECT b FROM f WHERE a = 'nation:3' UNION SELECT a FROM f WHERE b = 'nation:3'), i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM n),
l AS (SELECT 0 AS part, '' AS x, '' AS y, 'flowchart TD' AS line UNION ALL SELECT 1, id, '', '    n' || pos || '["' || id || '"]' FROM i
  UNION ALL SELECT 2, a, b, '    n' || s.pos || ' -->|' || label || '| n' || t.pos FROM f JOIN i s ON s.id = a JOIN i t ON t.id = b
  UNION ALL SELECT 3, id, '', '    style n' || pos || ' stroke-width:3px' FROM i WHERE id = 'nation:3')
SELECT row_number() OVER (ORDER BY part, x, y, line) AS line_no, line FROM l""")
def subgraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow around one nation as diagram lines."""
    return graph.subgraph_lines(graph.flow(edges(spark, sf_dir)), spark.createDataFrame([("nation:3",)], "id string"))


@registry.add("""WITH u AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS k FROM lineitem)
SELECT x.a, y.a AS b, count(*) AS n_shared FROM u x JOIN u y ON x.k = y.k AND x.a < y.a GROUP BY ALL""")
def shared_asset_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts."""
    return graph.shared_asset_links(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@registry.add("""WITH u AS (SELECT DISTINCT o_custkey AS a, l_partkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT x.a, y.a AS b, count(*) AS n_shared FROM u x JOIN u y ON x.k = y.k AND x.a < y.a GROUP BY ALL HAVING count(*) >= 2""")
def similar_overlap2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share two or more parts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    uses = table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.shared_asset_links(uses, "o_custkey", "l_partkey").where("n_shared >= 2")


@registry.add(f"WITH {EDGES_SQL}, k AS (SELECT 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 0) SELECT src AS id FROM d WHERE src NOT IN (SELECT id FROM k) UNION SELECT dst FROM d WHERE dst NOT IN (SELECT id FROM k)")
def stub_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that have no row of their own."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("id")
    known = t("nation").select(key("nation", "n_nationkey")).unionByName(t("region").select(key("region", "r_regionkey"))).unionByName(t("customer").where("c_acctbal > 0").select(key("customer", "c_custkey")))
    return graph.stubs(edges(spark, sf_dir), known)


@registry.add(f"WITH {EDGES_SQL} SELECT dst AS id, array_to_string(list_sort(list(DISTINCT src)), ',') AS ids FROM d WHERE rel = 'depends_on' GROUP BY 1")
def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that depend on each nation."""
    return graph.related(edges(spark, sf_dir), "depends_on").select("id", F.array_join("ids", ",").alias("ids"))
