"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import stored

LOCAL_EDGES = 200_000  # edges that a task connects at a time


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges but the least of its component, and that."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the same components within a task: all hang on the least node."""
    held, n = [], 0

    def done() -> pa.RecordBatch:
        u, v = _stars(*(np.concatenate(side) for side in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > LOCAL_EDGES:
            yield done()
            held, n = [], 0
    if held:
        yield done()


def components(links: DataFrame) -> DataFrame:
    """The root of every node of ``links`` (a, b: long): node, root.

    Edges are dealt to tasks, by count, and connected within each; where there
    are more tasks than one, rounds between them follow. Large-star joins the
    larger neighbours of a node to its least one, small-star the smaller ones;
    both only ever make edges shorter, and after about log(n) rounds every node
    hangs on the least of its component. Loops and repeated links do no harm;
    nodes without a link don't appear.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")),
        "edges",
    )
    tasks = -(-edges.count() // LOCAL_EDGES)
    if tasks:
        edges = stored(edges.coalesce(tasks).mapInArrow(_contracted, "u long, v long"), "edges")
    before = _state(edges) if tasks > 1 else (0,)
    while before[0]:
        # large-star: every neighbour above u hangs on the least of u's
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: every neighbour below u, and u, hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = stored(lower.union(own).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
