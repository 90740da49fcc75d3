"""Connected components of a link table: each task joins its own links, alternating large-star and small-star steps join what reaches into several tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, checkpoint, settled, small_checkpoint


#: Links that one task writes at least, and links that it holds before it begins a new forest.
TASK_LINKS, HELD_LINKS = 200_000, 1_600_000


def _least(links: DataFrame, least, tasks: int) -> DataFrame:
    """(u, m) with the aggregate m of each u: written first, so that a small one is broadcast and else the adaptive skew join can split a hot node's rows."""
    return small_checkpoint(links.groupBy("u").agg(least.alias("m")).coalesce(tasks))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, F.least(F.first("u"), F.min("v")), tasks)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, F.min("v"), tasks)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks)


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links that aren't the smallest of their component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    below = root < np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """The same components with at most one link a node and task: from each node to the smallest one that its task's links reach. `edges` go through one task if they aren't dealt already."""

    def contract(batches):
        def forest():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined(u, v)], ["u", "v"])

        u, v = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            more = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            u, v = (np.concatenate(x) for x in zip((u, v), more))
            if len(u) > 2 * TASK_LINKS:
                u, v = joined(u, v)
            if len(u) > HELD_LINKS:
                yield forest()
                u, v = u[:0], v[:0]
        yield forest()

    return arrow_map(edges.select("u", "v").coalesce(1) if dealt is None else dealt.select("u", "v"), contract, "u long, v long")


def _members(forest: DataFrame) -> DataFrame:
    """(node, root) of each node and root of the links from nodes to roots."""
    return forest.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(forest.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


@settled
def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for each node that stands in a link; root is the smallest node of its component.

    edges: long columns u and v, in any direction, repeated or not; self-links are ignored. Nodes are
    ordered numbers. The links are dealt by u to tasks of about TASK_LINKS; each joins what its own links
    connect, in plain arrays of bounded size, and keeps one link a node. Where one task holds them all, that is the result. Else only
    nodes with different roots in several tasks link these roots, and just these links go on: as many as one task may hold are joined there, more by
    rounds of joins and grouped minima: no neighbour list is ever gathered, so
    a node with very many links costs no more memory than others, and in the rounds the rows of a hot node are split by
    the adaptive skew join. A link with a null end is ignored, other columns aren't read. An empty table gives an empty result. Raises RuntimeError if the rounds do not
    suffice (their number grows as the logarithm of the longest path).
    """
    now = checkpoint(edges.where("u <> v").select("u", "v"))
    tasks = 1 + now.count() // TASK_LINKS  # few links don't make many small tasks and files
    if tasks == 1:
        return _members(checkpoint(_contracted(now)))
    members = checkpoint(_members(checkpoint(_contracted(now, now.repartition(tasks, "u")))))
    torn = members.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("node", "least")
    between = members.join(small_checkpoint(torn), "node").where("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v"))
    roots = small_checkpoint(_members(_settled_links(checkpoint(between.distinct()), max_rounds)).select(F.col("node").alias("root"), F.col("root").alias("top")))
    return members.join(roots, "root", "left").groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root"))


def _settled_links(now: DataFrame, max_rounds: int) -> DataFrame:
    """(u, v): a link from each node to the smallest one of its component, from distinct links with u > v."""
    mark = None
    for _ in range(max_rounds):
        tasks = 1 + (mark[0] if mark else now.count()) // TASK_LINKS
        if tasks == 1:
            return checkpoint(_contracted(now))
        now = checkpoint(_small_star(checkpoint(_large_star(now, tasks)), tasks))
        before, mark = mark, _mark(now)
        if before == mark:
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and a sum of hashes: two equal marks in a row mean that the step changed nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)
