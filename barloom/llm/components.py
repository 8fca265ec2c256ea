"""Connected components of a graph given as an edge table: edges are contracted within tasks, then by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Edges that a task contracts.
TASK_EDGES = 1 << 20


def join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
    """Bring ``root`` (of each place, the least one of its component) up to date with links between ``i`` and ``j``; whether anything changed."""
    changed = False
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return changed
        changed = True
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task to one from each node to the least that they reach."""
    held = [pdf[["a", "b"]].to_numpy(dtype=np.int64) for pdf in batches]
    if held:
        nodes, place = np.unique(np.concatenate(held), return_inverse=True)
        root, place = np.arange(len(nodes)), place.reshape(-1, 2)
        join(root, place[:, 0], place[:, 1])
        below = root != np.arange(len(nodes))
        yield pd.DataFrame({"a": nodes[below], "b": nodes[root[below]]})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over ``edges`` (a, b). Large: neighbours above a node go to its least neighbour. Small: those below it do, and the node with them."""
    if large:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        linked = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``edges`` (a long, b long; any direction, repeats and loops allowed) to (node, root): the least node reachable.

    Nodes without an edge to another one are absent. Tasks of about ``task_edges`` contract their edges first; where that is one task, nothing is left to do. Else rounds
    follow, each settled in the shared folder; they grow with the logarithm of the longest chain. An empty table gives an empty one.
    """
    edges = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    tasks = max(1, -(-edges.count() // task_edges))
    edges = settle(edges.repartition(tasks).mapInPandas(_contract, "a long, b long"))
    seen = None
    while tasks > 1:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = settle(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
