"""Connected components of links that stay distributed: union-find within partitions, stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import lean, stored


#: Links (of 16 bytes) that one task may hold.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links (a[i], b[i]): every node that isn't its set's smallest, and that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i in range(len(parent)):  # a parent is never larger, so that its root is known by now
        parent[i] = parent[parent[i]]
    root = nodes[parent]
    inner = root != nodes
    return nodes[inner], root[inner]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, roots, size = [], [], 0

    def joined() -> pa.RecordBatch:
        a, b = forest(np.concatenate(held), np.concatenate(roots))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for x in batches:
        held.append(x.column("a").to_numpy())
        roots.append(x.column("b").to_numpy())
        size += len(x)
        if size > 2_000_000:
            yield joined()
            held, roots, size = [], [], 0
    if held:
        yield joined()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """links: a, b (long). For each node but its component's smallest: a, and as b that smallest. Written to the shared folder.

    Links that local union-find leaves are, up to one_task of them, joined by one task; beyond it stars settle them. Both
    give the same.
    """

    def told(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first())

    edges = stored(links.mapInArrow(lean(_local), "a long, b long").distinct(), "forest")
    if edges.count() <= one_task:
        return stored(edges.coalesce(1).mapInArrow(lean(_local), "a long, b long"), "forest")
    before = told(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        if (now := told(edges)) == before:
            break
        before = now
    return edges
