"""Connected components of a graph given as edges (a, b) of longs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed_join, written

#: Up to so many edges (16 bytes each) one task finds all components; beyond it, stars do.
ONE_TASK_EDGES = 2_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, root = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def _lows(e: DataFrame, name: str) -> DataFrame:
    """Smallest neighbour and number of edges of each node."""
    return written(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), name)


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of ``edges`` (written; columns a, b): root is the smallest
    node reachable. Beyond ``one_task`` edges, large and small stars alternate (two
    aggregations and joins a round, O(log n) rounds; partial minima before every
    shuffle, and hubs are joined apart from the rest, so a hub is no hot task). Raises if
    ``rounds`` aren't enough."""
    if edges.count() <= one_task:
        return written(edges.select("a", "b").coalesce(1).mapInArrow(_one_task, "node long, root long"), "roots")
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lows(both, "low")
        large = keyed_join(both, low, "u", "c").withColumn("m", F.least("u", "m"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large")
        low2 = _lows(large, "low")
        small = keyed_join(large, low2, "u", "c").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        old, e = e, written(small.where("u != v").distinct(), "small")
        discard(old, low, large, low2)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components aren't found after {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return written(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "roots")
