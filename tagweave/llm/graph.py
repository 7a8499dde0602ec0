"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.plans.storage import drop, table

_HELD = 1 << 18  # edges that a task contracts at once


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges that is not the least of its component in them, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    home, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        x, y = home[a], home[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(home, np.maximum(x, y), np.minimum(x, y))
        while (home[home] != home).any():
            home = home[home]
    moved = np.flatnonzero(home != np.arange(len(nodes)))
    return nodes[moved], nodes[home[moved]]


def _contracted(batches):
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*np.concatenate(held, axis=1))], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column("u").to_numpy(), batch.column("v").to_numpy()]))
        size += batch.num_rows
        if size >= _HELD:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _state(e: DataFrame) -> tuple[int, int]:
    """Nodes that show that the edges are no stars yet, and nodes with an edge more than once."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("to")), F.struct(F.col("v").alias("x"), F.lit(None).cast("long").alias("to")))
    nodes = e.select(F.inline(ends)).groupBy("x").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.count("to").alias("up"), F.count("*").alias("every"))
    return tuple(nodes.agg(F.count_if(F.expr("lo != hi OR up > 0 AND every > up")), F.count_if(F.col("up") > 1)).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not the least of its component, and that least node.

    ``edges`` has long columns u and v; nulls and loops are passed over.  Each task first contracts the edges it reads,
    some at a time.  Each round is written to the shared folder; a hot node costs a partial aggregate and a skew-split
    join, never one task.  Whether the edges are stars is asked for by one aggregate, so no round is run to see that nothing changes.
    """
    now = table(edges.filter("u != v").select("u", "v").mapInArrow(_contracted, "u long, v long"), "edges")
    while True:
        unlike, twice = _state(now)
        if not unlike and not twice:
            return now
        before, now = now, table(_small_star(_large_star(now)) if unlike else now.distinct(), "edges")
        drop(before)
