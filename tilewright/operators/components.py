"""Connected components of an edge table, with no vertex's neighbours in one task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Edges that a task joins at a time.
HELD = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of some nodes as stars: every node but the least of its group, and that least one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars in place of the edges that a task holds: at most one edge for each of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= HELD:
                yield joined()
                held, size = [], 0
        if size:
            yield joined()

    return edges.mapInArrow(run, "u long, v long")


def _told(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater node to the lesser, with `open`: whether their component is no star yet. It is one as long as every node has no lesser neighbour, or one and no other."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    busy = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("up").alias("up")).where("n > 1 AND up > 0").select("x")
    held = busy.union(edges.join(busy, F.col("u") == F.col("x")).select("v")).distinct()
    return edges.join(held, F.col("v") == F.col("x"), "left").select("u", "v", F.col("x").isNotNull().alias("open"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    Tasks first join the edges they hold. As soon as all that are left fit into one task, it joins those and nothing is left to do. Before that, components that are stars around their least node
    are done and put aside, and on the others large-star and small-star steps alternate: each moves edges to the least neighbour, so a component becomes a star in about the logarithm of its
    size in rounds. Every round is checkpointed; one number, observed while it is written, reaches the driver.
    """

    def kept(e: DataFrame, counted: Column) -> tuple[DataFrame, int]:
        seen = Observation()
        e = checkpointed(e.observe(seen, F.count(F.when(counted, 1)).alias("n")))
        return e, seen.get["n"]

    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e, left = kept(_contracted(e), F.lit(True))
    done = []
    if left > HELD:
        e = checkpointed(e.distinct())
    while left > HELD:
        e, left = kept(_told(e), F.col("open"))
        done.append(e.where("NOT open").select("u", "v"))
        e = e.where("open").select("u", "v")
        if left <= HELD:
            break
        # e holds each edge from the greater node to the lesser
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(down, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(down.select("k", "m")).distinct())
    stars_ = checkpointed(_contracted(e.repartition(1)))
    for e in done:
        stars_ = stars_.union(e)
    stars_ = stars_.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars_.union(stars_.select(F.col("root").alias("node"), "root").distinct())
