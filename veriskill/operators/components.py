"""Connected components of an edge table of long ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriskill.sources.scratch import freed, written

#: Edges that one task contracts.
TASK_EDGES = 1 << 20


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the smallest node that each reaches over the edges: labels hook on labels, then jump."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around the smallest node that each node reaches within it."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    nodes, places = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
    label = least_reached(len(nodes), *np.split(places, 2))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of edges ``a, b`` (long) but the smallest of a component, which names it.

    Partitions of bounded size contract their edges to stars. One partition is the end; of several, every node's larger,
    then smaller neighbours move to its smallest until nothing changes. Tables of a round are deleted after the next.
    """
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
    seen = None
    while True:
        n, check = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        parts = math.ceil(n / TASK_EDGES)
        if parts == 0 or (n, check) == seen:
            break
        seen = (n, check)
        dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts, F.xxhash64("a", "b"))
        edges = freed(edges, written(dealt.mapInArrow(_contract, "a long, b long")))
        if parts == 1:
            break
        for larger in (True, False):
            edges = freed(edges, written(_star(edges, larger)))
    found = edges.toDF("node", "component")
    found._written_to = edges._written_to
    return found


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """From a > b to the same: all larger neighbours of a node, or the node with its smaller ones, move to its smallest neighbour."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = edges.unionByName(back) if larger else edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    if larger:
        moved = pairs.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()
