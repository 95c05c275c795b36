"""Connected components by alternating stars, each step a written table.

Every step replaces a node's links by links to its smallest neighbour, so chains shorten by
a large factor a round; a node with very many links is grouped with map-side combine and
joined by plain joins between written tables, which Spark can split when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import written

MAX_ROUNDS = 60  # a guard against endless loops; rounds grow with the log of a chain's length


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (node, low): each node, or its larger neighbours, pointed at its smallest one."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # a is the larger end
        near = edges
    least = written(near.groupBy("a").agg(F.min("b").alias("low")), "least").withColumn(
        "low", F.least("a", "low")
    )
    if large:
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select("a", F.col("low").alias("b"))
        )
    return written(moved.where("a > b").distinct(), "star")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable over ``edges`` (a, b: long), for each
    node that has an edge to another one. Loops on the spot and repeated edges do no harm."""
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = _star(_star(edges, large=True), large=False)
        state = edges.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"),
            F.sum(F.expr("cast(xxhash64(b, a) as decimal(38, 0))")),
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    # settled: every edge leads straight to the smallest node of its component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
