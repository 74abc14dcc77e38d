"""Connected components: spanning forests of parts of the edges, then alternating large and small stars where they are many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .session import drop_written, saved, written

#: Edges that a task joins at a time; where no more are left, one task ends the work.
PART = 1 << 19


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that edges join to a smaller one, and the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        x, y = parent[x], parent[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        # each root goes below the least root that an edge joins it to
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    below = parent != np.arange(len(nodes))
    return nodes[below], nodes[parent[below]]


def _forests(part: int):
    """(u, v) of the forest of every ``part`` edges of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            u, v = spanning_forest(*(np.concatenate(side) for side in zip(*held, strict=True)))
            return pa.record_batch({"u": u, "v": v})

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= part:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return run


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star over (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(root.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and a sum of their hashes, which are taken as they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def connect(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that an edge ``a, b`` joins to a smaller one; roots are the least of their component.

    Nodes without edges, and roots, have no row.  Tasks first replace the
    edges that they read by a spanning forest of them.  Where PART edges at
    most are left, one task joins them all; else stars do, every round of
    which is written to the shared folder, and the number of rounds grows with
    the logarithm of the longest path.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    forests, n = saved(pairs, "edges", _forests(PART), "u long, v long")
    if n <= PART:
        # one forest of all: a task that reads no more than PART edges yields once
        now, _ = saved(forests.coalesce(1), "edges", _forests(PART + 1), "u long, v long")
        drop_written(forests)
    else:
        now, state = _written(forests.distinct())
        drop_written(forests)
        while True:
            after, new = _written(_round(now))
            drop_written(now)
            now = after
            if new == state:
                break
            state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
