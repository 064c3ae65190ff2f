"""Connected components by alternating large and small stars.

Every round is two joins on node ids over the edge table; nothing but the
number of edges and a checksum reaches the driver. Each round is written to
the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node under the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.filter("b > a").join(least, "a").filter("b != low").select(
        F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours under the least of them; edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    hung = edges.join(least, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge (a, b).

    Self-loops and repeated edges do no harm; a table without edges gives none.
    Nodes are of any ordered type and not null.
    """
    now = stored(edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
