"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014), each round written to the shared folder.  Every partition first replaces its own edges
by a spanning forest, so what is shuffled is at most nodes x partitions.  A graph of at most FOREST_EDGES edges after that
is finished by one task.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batch, map_batches

#: Edges that a task turns into a forest at once; bounds its memory.
FOREST_EDGES = 2_000_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each node's component (numpy pointer jumping)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        far = low != high
        if not far.any():
            break
        a, b, low, high = a[far], b[far], low[far], high[far]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        e = np.concatenate(held)
        held.clear()
        nodes, at = np.unique(e, return_inverse=True)
        at = at.reshape(-1, 2)
        root = roots(len(nodes), at[:, 0], at[:, 1])
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        return batch(a=nodes[leaf], b=nodes[root[leaf]])

    n = 0
    for x in batches:
        if x.num_rows:
            held.append(np.stack([x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)], 1))
            n += x.num_rows
        if n >= FOREST_EDGES:
            yield flush()
            n = 0
    if n:
        yield flush()


def components(edges: DataFrame, work: Workspace, max_rounds: int = 60, at_once: int = FOREST_EDGES) -> DataFrame:
    """(node, component) for each node on an edge; component is the smallest node reachable.

    edges: columns a, b of bigint.  Loops and repeats don't matter; an edge with a null end is ignored.
    Nodes without edges don't appear.
    """
    forest = lambda e: map_batches(e, _forest, "a bigint, b bigint")
    # Edges often come from a Python function: written first, so that no task runs two Python workers.
    given = work.keep(edges.select("a", "b").filter("a <> b"), "given")
    now = work.keep(forest(given).distinct(), "edges")
    work.drop(given)
    if now.count() <= at_once:
        stars = work.keep(forest(now.coalesce(1)), "stars")
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        # Large star: every larger neighbour of u is tied to u's smallest neighbour.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        down = work.keep(large.filter("a <> b").distinct(), "large")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = work.keep(small.filter("a <> b").distinct(), "small")
        work.drop(down)
        work.drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
