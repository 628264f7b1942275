"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: Leaves (paths of the tree) that the driver plans for; more raise. Rows of a leaf in one range of its order, about.
MOST_LEAVES, RANGE = 200_000, 10_000
NONE = "(none)"


def water(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares of a budget by weight, none over its room; what some can't take goes to their siblings by weight."""
    out, open_ = [0.0] * len(room), [i for i in range(len(room)) if room[i] > 0 and weights[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= room[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = room[i]
        left -= sum(room[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(leaves: dict[tuple, int], weights: dict[tuple, float], total: float, epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf (a path of names, all of one length). weights: of a node by its path; a node that has none
    takes that of its last name under "*" (("*", name)), else 1. A node has room for `epochs` times its tokens. From
    the root down, a node's budget goes to its children by weight, and what a child has no room for to its siblings;
    only what no sibling has room for stays with the parent's siblings, because a parent never gets more than its room."""
    tree: dict[tuple, dict[tuple, None]] = {}
    room: dict[tuple, int] = {}
    for path, tokens in sorted(leaves.items()):
        for k in range(len(path) + 1):
            room[path[:k]] = room.get(path[:k], 0) + tokens * epochs
            if k:
                tree.setdefault(path[: k - 1], {})[path[:k]] = None
    out: dict[tuple, int] = {}
    todo: list[tuple[tuple, float]] = [((), min(total, room.get((), 0)))]
    while todo:
        node, budget = todo.pop()
        if node not in tree:
            if node:
                out[node] = int(budget + 1e-6)
            continue
        children = list(tree[node])
        given = water(budget, [weights.get(c, weights.get(("*", c[-1]), 1.0)) for c in children], [room[c] for c in children])
        todo += zip(children, given)
    return out


def mix(docs: DataFrame, levels: list[Column], tokens: Column, weights: dict[tuple, float], total: float | None = None, share: float | None = None, epochs: int = 1, seed: int = 0, id: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """Which rows to take: id, path (array<string>), tokens, epoch (from 0), a row for each time a document is taken.

    levels: the names of a leaf from the root down (null counts as the name "(none)"). The budget is `total` tokens, or
    `share` of all. In each epoch a leaf's documents stand in the order of a hash seeded by (seed, epoch, id), ties by id
    and tokens; its budget takes whole epochs first, then the longest prefix of the next that doesn't exceed it. Null
    tokens count as 0. Rows of a null id take part. Rows of equal id are apart. No row of the input is left out of
    the sums; a leaf, however large, is ordered in ranges of its hashes, not in one task. carried: columns that come out
    as well and decide ties that are left."""
    spark = docs.sparkSession
    path = F.array(*(F.coalesce(c.cast("string"), F.lit(NONE)) for c in levels))
    slim = settle(docs.select(F.col(id).alias("id"), path.alias("path"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"), *carried))
    sums = slim.groupBy("path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    leaves = {tuple(r["path"]): r["tokens"] for r in sums}
    plan = budgets(leaves, weights, sum(leaves.values()) * share if total is None else total, epochs)
    rows = []
    for r in sums:
        budget = plan[tuple(r["path"])]
        whole = epochs if not r["tokens"] else min(epochs, budget // r["tokens"])
        rows.append((r["path"], int(whole if r["tokens"] else 0), int(budget - whole * r["tokens"]) if r["tokens"] else 0, max(1, -(-r["n"] // RANGE))))
    planned = spark.createDataFrame(rows, "path array<string>, whole int, rest long, ranges long")
    known = slim.join(F.broadcast(planned), "path")  # at most MOST_LEAVES rows
    whole = known.where("whole > 0").select("id", "path", "tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), *carried)
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "whole", F.coalesce(F.col("id").cast("string"), F.lit(""))), 1)
    placed = known.where("rest > 0").select("*", order.alias("h")).withColumn("r", F.shiftright(F.shiftright("h", 32) * F.col("ranges"), 31))
    ranges = placed.groupBy("path", "r").agg(F.sum("tokens").alias("own"))
    before = Window.partitionBy("path").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "r", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    # the range in which a leaf's budget ends: earlier ones are taken whole, later ones not at all, it alone is ordered
    budget = planned.select("path", F.col("rest").alias("most"))
    ends = ranges.join(F.broadcast(budget), "path").where("before <= most").groupBy("path").agg(F.max("r").alias("last"), F.max("before").alias("before"))
    near = placed.join(F.broadcast(ends), "path")  # at most MOST_LEAVES rows
    early = near.where("r < last").select("id", "path", "tokens", F.col("whole").alias("epoch"), *carried)
    within = Window.partitionBy("path").orderBy("h", "id", "tokens", *carried).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = near.where("r = last").withColumn("sum", F.col("before") + F.sum("tokens").over(within)).where("sum <= rest")
    part = early.union(cut.select("id", "path", "tokens", F.col("whole").alias("epoch"), *carried))
    return whole.union(part).withColumnRenamed("id", id)
