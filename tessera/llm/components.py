"""Connected components of an edge table: each task contracts the edges it holds, alternating large-star and small-star
steps, in joins and aggregates, connect what tasks hold apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

#: Edges that a task contracts at once.
HELD = 1_000_000


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges a[i]-b[i]: each node that isn't the least of those it reaches, and that least one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        now = root.copy()
        np.minimum.at(now, np.concatenate([root[x], root[y]]), np.concatenate([low, low]))
        while (now != now[now]).any():
            now = now[now]
        root = now
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    some = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[some], nodes[root[some]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rooted(table["a"].to_numpy(), table["b"].to_numpy())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= HELD:
            yield done()
            held = []
    if held:
        yield done()


def _stars(edges: DataFrame) -> bool:
    """Each node has one link down or any number of links up, not both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("all"), F.min("down").alias("least"))
    return not nodes.where("all > 1 or all = 1 and least = 0").agg(F.count("*")).first()[0]


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): two 64-bit nodes each, in any order, repeats and loops allowed. Returns (node, root) for every node
    that has a link to another; root is the least node reachable. A node's neighbours are never brought into one
    task: the least of them comes from a map-side aggregate and goes back by a join that Spark can split."""
    sides = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = settle(sides.distinct().mapInArrow(_contracted, "a long, b long"))
    while not _stars(now):  # small tables end here: a query for each step is what the driver pays for
        large = settle(_large(now))
        then = settle(_small(large).mapInArrow(_contracted, "a long, b long"))
        discard(now, large)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
