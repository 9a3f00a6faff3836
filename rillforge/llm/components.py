"""Connected components of an edge list, by local forests and then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: Edges that one task reduces to a forest.
EDGES_PER_TASK = 1_000_000


class UnionFind:
    """Sets of integers, each named by its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        while (up := p.setdefault(x, x)) != x:
            p[x] = x = p[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def least_of_component(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges (u, v), and the least end of each one's component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars: each node with the least of its local component."""
    ends = [[batch.column(i).to_numpy() for i in (0, 1)] for batch in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(e[i] for e in ends)]) for i in (0, 1))
    nodes, least = least_of_component(u, v)
    hangs = nodes != least
    yield pa.RecordBatch.from_arrays([pa.array(nodes[hangs], pa.int64()), pa.array(least[hangs], pa.int64())], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long); a component is named by its least node.

    Tasks of at most about ``edges_per_task`` edges first reduce their edges to stars. If there was
    one task, that is the result; else rounds hang neighbours on the least neighbour until nothing
    changes. Edges and labels stay on the executors; each round is cut from its lineage by a checkpoint.
    """
    edges = checkpointed(edges.where("u != v").select("u", "v"))
    tasks = max(1, -(-edges.count() // edges_per_task))
    edges = checkpointed(edges.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
    state = _state(edges) if tasks > 1 else (0,)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: what is greater than u hangs on the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is less than u, and u, hang on the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u != v").distinct())
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
