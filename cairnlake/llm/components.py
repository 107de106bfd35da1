"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (partial sums first) and a join with the table of minima, so a hub
with very many neighbours is no single task's group; each step's result is written to the shared
folder.  Nothing is collected but a count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, shared_dir


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """Edges (a, b) with a > b, and the folders written.  Large: each node's larger neighbours move to its
    least neighbour.  Small: its smaller neighbours and itself do."""
    paths = [shared_dir(edges.sparkSession) for _ in range(2)]
    ways = edges.select("a", "b")
    if large:
        ways = ways.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(ways.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), paths[0])
    met = ways.join(least, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return materialise(moved.where("a != b").distinct(), paths[1]), paths


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge; root is the least node of the component.
    Edges come as columns a and b, in either direction, loops and repeats allowed; an edge with a
    null end is none.  Tables of earlier steps are deleted as soon as the next ones stand."""
    spark = edges.sparkSession

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    old = [shared_dir(spark)]
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), old[0])
    said = mark(now)
    while said[0]:
        half, first = _star(now, large=True)
        now, second = _star(half, large=False)
        before, said = said, mark(now)
        for path in [*old, *first, second[0]]:
            release(spark, path)
        old = [second[1]]
        if said == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
