"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to its smallest neighbour (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    ``edges`` holds pairs (u, v) of longs, any way round, repeats and loops allowed. Rows stay as many as
    links, and the number of rounds grows with the logarithm of a component's size. Every round
    is a table in the shared folder, so lost executors cost one round at most.
    """
    links = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = materialise(links, "components")
    before = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                state.select("v", "v").distinct()
            )
        before = now
        state = materialise(_small_star(_large_star(state).distinct()).distinct(), "components")
