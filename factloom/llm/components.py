"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; every round is a table in the shared folder.  The number of rounds
grows with the logarithm of the longest path, and the number of edges never grows.  Before
the first, each task contracts the edges it happens to have to a star for each of their own
components, which leaves fewer and shorter paths; then as many tasks as have HELD of those
edges each do it once more, so that what many small tasks have left takes few rounds or none.
The least neighbour of each node is a
table of its own, so that the join with it shuffles both sides and adaptive execution may
split a node with very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _least(edges: DataFrame) -> DataFrame:
    """For each node u of (u, v) rows the least of u and its neighbours."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


#: Edges that a task contracts at a time.
HELD = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u > v) as stars of the components that a stretch of them has; each star's centre is its least node."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD:
            yield _star(held)
            held.clear()
    if held:
        yield _star(held)


def _star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    u, v = (table.column(c).to_pylist() for c in ("u", "v"))
    u, v = ([tuple(x.values()) if isinstance(x, dict) else x for x in c] for c in (u, v))
    up: dict = {}

    def find(x):
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for a, b in zip(u, v, strict=True):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = [x for x in up if find(x) != x]
    kind = table.schema.field("u").type
    again = (lambda xs: [dict(zip((f.name for f in kind), x, strict=True)) for x in xs]) if pa.types.is_struct(kind) else (lambda xs: xs)
    return pa.RecordBatch.from_arrays([pa.array(again(nodes), kind), pa.array(again([find(x) for x in nodes]), kind)], names=["u", "v"])


def _rooted(edges: DataFrame) -> bool:
    """Whether every node has one neighbour, and none that has a smaller one itself."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    return not several.take(1) and not edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node that can be reached.

    Null ends are ignored, loops and repeated edges are allowed; no edges give no rows.
    """
    kind = edges.schema[0].dataType
    edges = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(edges.mapInArrow(_stars, edges.schema), "edges")
    tasks = -(-edges.count() // HELD)
    if tasks:
        edges = edges.coalesce(tasks).mapInArrow(_stars, edges.schema)
        edges = materialize(edges.distinct() if tasks > 1 else edges, "edges")
    while not _rooted(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "edges")
        small = large.join(_least(large), "u").select("v", "m", "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).select(F.col("node").cast(kind), F.col("root").cast(kind))
