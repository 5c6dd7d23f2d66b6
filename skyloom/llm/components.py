"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars around the smallest node of each of the batch's own components."""
    for batch in batches:
        ids, ends = np.unique(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]), return_inverse=True)
        left, right = ends.reshape(2, -1)
        parent = np.arange(len(ids))
        while True:
            low = parent.copy()
            np.minimum.at(low, left, parent[right])
            np.minimum.at(low, right, parent[left])
            low = np.minimum(low, low[low])
            if (low == parent).all():
                break
            parent = low
        far = np.flatnonzero(parent != np.arange(len(ids)))
        yield pa.record_batch([pa.array(ids[far]), pa.array(ids[parent[far]])], names=["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` but the smallest of each component, which names it.

    Edges that repeat, run both ways or join a node with itself do no harm; no
    edges give no rows.  Rounds grow with the logarithm of the longest path, and
    what a round holds for one node is two numbers.
    """
    found = materialise(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "forest")
    before = _mark(found)
    while before[0]:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
        # both branches below read one shuffle of this, so it is not written
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", "least"), F.struct(F.col("b").alias("a"), "least"))).alias("e"))
        found = materialise(small.select("e.a", F.col("e.least").alias("b")).filter("a <> b").distinct(), "small-star")
        after = _mark(found)
        if after == before:
            break
        before = after
    return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
