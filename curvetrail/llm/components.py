"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import drop_table, materialize, salted_join


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its least neighbour."""
    both = _both(edges)
    # a node without a smaller neighbour keeps its own; the center of a large star mostly is one
    least = both.where("b < a").groupBy("a").agg(F.min("b").alias("least"))
    return salted_join(both.where("b > a"), least, ["a"], F.col("b")).select(F.col("b").alias("a"), F.coalesce("least", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = salted_join(down, least, ["a"], F.col("b"), "inner").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select("a", F.col("least").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) to (id, class): the least id that each node is connected with. Nodes without edges are absent.
    Every round shuffles edges by node, those of one node over several tasks, and never gathers a component; edge tables
    between rounds are written out."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        after = materialize(_small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct(), "edges")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("class")).unionAll(roots)
