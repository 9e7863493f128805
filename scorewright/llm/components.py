"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.sources.storage import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (or the smaller) neighbours of each node to its smallest neighbour."""
    near = _both_ways(edges)
    if not larger:
        near = near.where("b < a")
    least = materialize(
        near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "component-least"
    )
    joined = near.join(least, "a")
    if larger:
        tied = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        tied = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return materialize(tied.where("a > b").distinct(), "component-edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is its least node.

    Rounds of ties to the least neighbour, of the larger and of the smaller neighbours in
    turn, end with one star for each component after a logarithmic number of rounds.  The
    least neighbour is combined before the shuffle and the written table of it joined, so
    a node with very many neighbours is split.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "component-edges",
    )
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
    before, now = None, current.agg(mark).first()[0]
    while now != before:
        before = now
        current = _stars(_stars(current, True), False)
        now = current.agg(mark).first()[0]
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )
