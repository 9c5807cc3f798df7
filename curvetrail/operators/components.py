"""Connected components of many graphs at once, by contracting stars.

An edge table holds the edges of all graphs; keys name the graph. Tasks first contract what they hold, block by block, so
that a component within a block is a star around its least node at once. While some component is not a star yet, a round
joins the edges by node: every node hands its larger neighbours to the least node that it knows, then itself and its
smaller neighbours. Rounds grow with the logarithm of a component's size; adaptive execution splits the joins where a
node has many edges, and the edges between rounds are a table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.plans.staging import dropped, staged

#: Edges that a task contracts at a time.
BLOCK_EDGES = 100_000


def _stars(edges: list[tuple]) -> dict[tuple, tuple]:
    """Edges (graph and node, graph and node) to the least node of each node's part."""
    up: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, hi, lo): the stars of each block of edges."""
    held: list[tuple] = []
    names = types = None

    def block() -> pa.RecordBatch:
        stars = [(*x, r[-1]) for x, r in _stars([(e[:-1], (*e[:-2], e[-1])) for e in held]).items() if x != r]
        held.clear()
        columns = zip(*stars) if stars else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        names, types = batch.schema.names, batch.schema.types
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) >= BLOCK_EDGES:
            yield block()
    if held:
        yield block()


def _handed_on(edges: DataFrame, keys: list[str], larger: bool) -> DataFrame:
    """Edges (hi > lo) after each node passed on its larger neighbours (else itself and its smaller ones) to the least node
    that it knows."""
    seen = edges.select(*keys, F.col("hi").alias("at"), F.col("lo").alias("to"))
    if larger:
        seen = seen.unionAll(edges.select(*keys, "lo", "hi"))
    least = seen.groupBy(*keys, "at").agg(F.least("at", F.min("to")).alias("least"))
    met = seen.join(least, [*keys, "at"])
    if larger:
        return met.where("to > at").select(*keys, F.col("to").alias("hi"), F.col("least").alias("lo")).distinct()
    moved = met.where("to > least").select(*keys, F.col("to").alias("hi"), F.col("least").alias("lo"))
    return moved.unionAll(least.select(*keys, F.col("at").alias("hi"), F.col("least").alias("lo"))).distinct()


def _all_stars(edges: DataFrame, keys: list[str]) -> bool:
    """Whether each node has one smaller neighbour or larger ones, not both and not several smaller."""
    ends = edges.select(*keys, F.col("hi").alias("node"), "lo").unionAll(edges.select(*keys, F.col("lo").alias("node"), F.lit(None).cast(edges.schema["lo"].dataType)))
    per = ends.groupBy(*keys, "node").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.max(F.col("lo").isNull()).alias("center"))
    return per.where("least is not null and (least <> most or center)").isEmpty()


def components(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, component): the least node that each node is connected with. Edges of a node with itself, with a null
    node or repeated ones are none; nodes without edges are absent."""
    first = edges.where(F.col(a) != F.col(b)).select(*keys, F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now = staged(first.mapInArrow(_contract, first.schema), "edges")
    while not _all_stars(now, keys):
        after = staged(_handed_on(_handed_on(now, keys, True), keys, False).mapInArrow(_contract, first.schema), "edges")
        dropped(now)
        now = after
    roots = now.select(*keys, F.col("lo").alias("node"), F.col("lo").alias("component"))
    return now.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots).distinct()
