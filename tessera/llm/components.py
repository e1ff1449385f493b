"""Connected components by alternating large-star and small-star steps, each an aggregation and a join.

Up to LOCAL edges (a bound that is checked, 16 bytes each) one executor task does the same faster than many small jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, node: str, other: str, small: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest of them and the node; a hub is aggregated, not gathered."""
    lowest = edges.groupBy(F.col(node).alias("hub")).agg(F.min(other).alias("low"))
    lowest = lowest.select("hub", F.least("hub", "low").alias("low"))
    tied = edges.join(lowest, edges[node] == lowest["hub"]).select(F.col(other).alias("a"), F.col("low").alias("b"))
    if small:
        tied = tied.unionByName(lowest.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return tied.where("a <> b").distinct()


#: Edges that one task takes.
LOCAL = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest node that the edges a-b reach from each: labels sink along edges and jump to their labels' labels."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        a, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_reachable(a, b)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (the smallest node that edges reach) for each node of an edge between different nodes."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now, before = stored(now, "edges"), None
    if now.count() <= LOCAL:
        return _in_one_task(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "a", "b", small=False).where("a > b")
        now = stored(_star(large, "a", "b", small=True), "edges")
        # a row count and two sums of hashes tell whether the set of edges is still the same
        h = F.xxhash64("a", "b")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 8)), F.bit_xor(h)).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = state
