"""Distributed union-find: connected components of a graph given as links between long ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code, written


def find(parent: dict, x: int) -> int:
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def unite(parent: dict, x: int, y: int) -> None:
    a, b = find(parent, x), find(parent, y)
    if a != b:
        parent[max(a, b)] = min(a, b)


#: A task's union-find is emptied when it knows so many nodes; what it emits keeps all connections.
NODES_AT_ONCE = 1_000_000


def _stars(parent: dict) -> pa.RecordBatch:
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(parent, x) for x in list(parent)), np.int64, len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task become stars with the smallest node in the middle."""
    parent: dict[int, int] = {}
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            unite(parent, x, y)
        if len(parent) > NODES_AT_ONCE:
            yield _stars(parent)
            parent = {}
    if parent:
        yield _stars(parent)


def _state(links: DataFrame) -> tuple:
    """Equal for two rounds only if the set of links is the same."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame, name: str) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for nodes of at least one link a <> b.

    Rounds of large stars and small stars. Only smallest neighbours are aggregated, never
    neighbour lists, so a node with very many links is a key of a partial aggregate. Each
    round is written to the shared folder; its links are no more than the nodes' links before.
    Nulls are no nodes; no links give no rows.
    """
    ship_code(links.sparkSession)
    clean = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    star = written(clean.mapInArrow(_contract, "a long, b long").filter("a <> b").distinct(), f"{name}-links")
    state = _state(star)
    while True:
        star = written(_small_star(_large_star(star)), f"{name}-links")
        now = _state(star)
        if now == state:
            break
        state = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "n"))
    out = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the smallest of them. Links run from larger to smaller."""
    least = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = links.join(least, links["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(kept).filter("a <> b").distinct()
