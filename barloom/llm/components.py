"""Connected components of a graph: in one task while its edges fit there, by alternating star contractions beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed

#: Distinct edges that one task joins (16 bytes each, some 100 while it works).
ONE_TASK = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, ascending, and the smallest node of the component of each."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return nodes, nodes[root]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all edges (a, b) of a task."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        nodes, roots = roots_of(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        for at in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 10_000]), pa.array(roots[at : at + 10_000])], names=["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges(a, b)`` (long).

    Up to ``ONE_TASK`` edges are joined in one task: rounds of them are stages of next to nothing, whose many small files and
    tasks cost more than the edges.  Of more edges, large-star and small-star steps alternate until the edges no longer change; each step is one
    aggregation and one join on the nodes, about log of the diameter of them.  The edges never reach the
    driver: it sees their number and a checksum.  Every round is a checkpoint, so a lost executor costs one round.
    """
    state = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if state.count() <= ONE_TASK:
        return state.coalesce(1).mapInArrow(joined, "node long, root long")
    before = None
    while True:
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large)
        low = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = checkpointed(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before or after[0] == 0:
            break
        before = after
    roots = state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
