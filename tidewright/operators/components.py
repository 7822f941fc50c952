"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (hi, lo) with hi > lo.

    Large star links every larger neighbour of a node to the least node it knows; small star
    links the smaller ones. Both keep the components and shrink the diameter."""
    both = edges.select("hi", "lo")
    if large:
        both = both.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    around = both.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
    least = around.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    joined = around.join(least, "node")
    out = joined.where(F.col("near") > F.col("node") if large else F.lit(True)).select("near", "least")
    if not large:
        out = out.unionByName(least.select(F.col("node").alias("near"), "least"))
    return out.where("near > least").select(F.col("near").alias("hi"), F.col("least").alias("lo")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Label each node of an undirected edge list with the least node it reaches.

    Returns (node, component), one row per node named by an edge; self-loops give singletons.
    Rows with a null end name no edge and are left out. Node columns may be of any orderable
    type. Every round is written to the shared checkpoint folder; rounds grow with the
    logarithm of the longest chain. State on the driver is two numbers a round.
    """
    ends = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = cut(ends.distinct())
    nodes = ends.select(F.col("hi").alias("node")).unionByName(ends.select(F.col("lo").alias("node"))).distinct()
    state, links = None, ends.where("hi > lo")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    for _ in range(max_rounds):
        links = cut(_star(_star(links, large=True), large=False))
        now = tuple(mark(links))
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links.select(F.col("hi").alias("node"), "lo"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))
