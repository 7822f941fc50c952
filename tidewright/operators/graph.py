"""Typed edges, their flow, and walks over it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import cut

#: Which way impact flows along a relation (fixed values of the data model): forward from src
#: to dst, or back; others carry none.
FORWARD, BACK = {"writes": "writes", "builds": "builds", "swaps": "swaps"}, {"reads": "read by", "alias_of": "served as", "depends_on": "triggers"}


def edges_of(df: DataFrame, src, rel: str, dst, source: str) -> DataFrame:
    """(src, rel, dst, source) rows out of two columns or expressions."""
    return df.select(src.cast("string").alias("src"), F.lit(rel).alias("rel"), dst.cast("string").alias("dst"), F.lit(source).alias("source"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, rel, dst): the least source stands for the first."""
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "rel", "dst").agg(F.min("source").alias("source"))


def flow(edges: DataFrame, forward: Mapping[str, str] = FORWARD, back: Mapping[str, str] = BACK) -> DataFrame:
    """(a, b, label): edges in the direction that impact flows, one per pair; of parallel ones
    the greatest label."""
    names = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    parts = []
    if forward:
        parts.append(edges.where(F.col("rel").isin(*forward)).select(F.col("src").alias("a"), F.col("dst").alias("b"), names(forward)[F.col("rel")].alias("label")))
    if back:
        parts.append(edges.where(F.col("rel").isin(*back)).select(F.col("dst").alias("a"), F.col("src").alias("b"), names(back)[F.col("rel")].alias("label")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("a", "b").agg(F.max("label").alias("label"))


def walk(flows: DataFrame, starts: DataFrame, hops: int = 3, up: bool = False) -> DataFrame:
    """(start, id, distance, via, label): what each start (column id) reaches in at most `hops`
    steps, at its least distance, with the least predecessor there; without the start itself.

    The flow is written once; one join per hop on the frontier only; what was reached before is
    anti-joined away."""
    step = cut(flows.select(*((F.col("b").alias("at"), F.col("a").alias("to")) if up else (F.col("a").alias("at"), F.col("b").alias("to"))), "label"))
    frontier = starts.select(F.col("id").alias("start"), "id").distinct()
    reached = frontier.withColumns({"distance": F.lit(0), "via": F.lit(None).cast("string"), "label": F.lit(None).cast("string")})
    for d in range(1, hops + 1):
        best = F.min(F.struct(F.col("id").alias("via"), "label"))
        nxt = frontier.join(step, F.col("id") == F.col("at")).groupBy("start", "to").agg(best.alias("v"))
        nxt = nxt.select("start", F.col("to").alias("id"), F.lit(d).alias("distance"), F.col("v.via").alias("via"), F.col("v.label").alias("label"))
        nxt = cut(nxt.join(reached.select("start", "id"), ["start", "id"], "left_anti"))
        reached = reached.unionByName(nxt)
        frontier = nxt.select("start", "id")
    return reached.where("distance > 0")


def neighbors(edges: DataFrame, entity: str) -> DataFrame:
    """Edges at either side of an entity."""
    return edges.where((F.col("src") == entity) | (F.col("dst") == entity))


def impact(flows: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """Both directions of walk, with `direction`."""
    return walk(flows, starts, hops).withColumn("direction", F.lit("down")).unionByName(walk(flows, starts, hops, up=True).withColumn("direction", F.lit("up")))


def subgraph_lines(flows: DataFrame, starts: DataFrame, hops: int = 1, up_hops: int = 1) -> DataFrame:
    """(line_no, line): the flow among what the starts reach, as the text of a diagram: its head,
    a line per node in order of ids, a line per edge by its ends, a thicker frame for each start.

    Nodes are numbered by partitions of their order and offsets of these, not in one task."""
    nodes = walk(flows, starts, hops).select("id").unionByName(walk(flows, starts, up_hops, up=True).select("id")).unionByName(starts.select("id")).distinct()
    nodes = _numbered(nodes, "id")
    inside = flows.join(nodes.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(nodes.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    parts = [
        nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("x"), F.lit("").alias("y"), F.lit("flowchart TD").alias("line")),
        nodes.select(F.lit(1).alias("part"), F.col("id").alias("x"), F.lit("").alias("y"), F.concat(F.lit("    "), name("at"), F.lit('["'), "id", F.lit('"]')).alias("line")),
        inside.select(F.lit(2).alias("part"), F.col("a").alias("x"), F.col("b").alias("y"), F.concat(F.lit("    "), name("at_a"), F.lit(" -->|"), "label", F.lit("| "), name("at_b")).alias("line")),
        starts.select("id").distinct().join(nodes, "id").select(F.lit(3).alias("part"), F.col("id").alias("x"), F.lit("").alias("y"), F.concat(F.lit("    style "), name("at"), F.lit(" stroke-width:3px")).alias("line")),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return _numbered(lines, "part", "x", "y", "line").select((F.col("at") + 1).alias("line_no"), "line")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with at, from 0 in order: ranges of the order are counted by themselves, and what
    stands before a range is added. Rows are written first, so that ranges stay as they are."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn("at", F.col("_before") + F.col("_in") - 1).drop("_range", "_in", "_before")


def stubs(edges: DataFrame, entities: DataFrame, entity: str = "id") -> DataFrame:
    """Ends of edges that no entity describes."""
    ends = edges.select(F.col("src").alias(entity)).unionByName(edges.select(F.col("dst").alias(entity))).distinct()
    return ends.join(entities.select(entity), entity, "left_anti")


def related(edges: DataFrame, rel: str, by: str = "dst") -> DataFrame:
    """(id, ids): the entities on the other side of a relation, distinct and sorted."""
    other = "src" if by == "dst" else "dst"
    return edges.where(F.col("rel") == rel).groupBy(F.col(by).alias("id")).agg(F.array_sort(F.collect_set(other)).alias("ids"))


def pairs_by_key(uses: DataFrame, who: str, key: str, block: int = 256) -> DataFrame:
    """(k, a, b), a < b: those that share a key, once a key.

    The members of a key are dealt into blocks of about `block`, and two blocks at a time are
    joined, so that the pairs of a hot key come from many tasks."""
    x = uses.select(F.col(who).alias("m"), F.col(key).alias("k")).distinct()
    parts = x.groupBy("k").agg(F.ceil(F.count("*") / block).alias("parts"), F.count("*").alias("n")).where("n > 1")
    x = x.join(parts.select("k", "parts"), "k").withColumn("block", F.pmod(F.xxhash64("m"), F.col("parts")))
    left = x.select("k", F.col("m").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("parts") - 1)).alias("j"))
    right = x.select("k", F.col("m").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"))
    pairs = left.join(right, ["k", "i", "j"]).where("i < j OR x < y")
    return pairs.select("k", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")


def shared_asset_links(uses: DataFrame, who: str, asset: str) -> DataFrame:
    """(a, b, n_shared): pairs that use the same asset, a < b, with how many they share."""
    return pairs_by_key(uses.where(F.col(who).isNotNull()), who, asset).groupBy("a", "b").agg(F.count("*").alias("n_shared"))
