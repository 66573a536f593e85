"""Connected components of an edge table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriskill.llm.common import discard, materialize

#: Edges that one task contracts in memory.
TASK_EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars around the smallest node that each reaches within the partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge to another but the smallest of each component, which is the component.

    Partitions of bounded size contract their edges to stars; while there are several partitions, star rounds
    (each node's neighbours move to its smallest one) follow until nothing changes. Node ids are long.
    """
    edges = materialize(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        n, check = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        parts = math.ceil(n / TASK_EDGES)
        if parts == 0 or (n, check) == seen:
            break
        seen = (n, check)
        before, edges = edges, materialize(edges.repartition(parts).mapInArrow(_contract, "a long, b long"), "edges")
        discard(before)
        if parts == 1:
            break
        before, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        discard(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node's larger neighbours join its smallest; small: every node and its smaller neighbours do. From a > b to the same."""
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if large else pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a")
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()
