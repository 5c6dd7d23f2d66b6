"""Exact top-k search by integer inner products with MaxScore pruning.

Vectors are terms and weights: a query's terms are its components, a term's
postings are all vectors' values there, kept by column in shards of the vector
table.  Each shard has the largest and smallest value of every term, which
bounds what a term can add to a score.  For each query and shard the terms are
ordered by bound; as long as the bounds of the weakest ones together cannot
reach the query's tenth best score so far, they are non-essential.  Essential
postings are traversed for all vectors of the shard, a candidate is probed in
the other terms only while its partial score and their bound still compete, and
the shards' best lists are merged.

Queries and shards meet in blocks of bounded size: each shard goes to every
block of queries, which is the stated search of a query set against all rows.

Defined results
    null vectors, null or non-finite components   take no part, not as queries either
    vectors of unlike lengths     missing components count as zero
    equal scores                  the smaller vec_id first
    repeated vec_id               each row is a candidate; rows with the query's own id are not
    null vec_id                   takes no part
    fewer candidates than k       all of them
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import materialise

#: Vectors of a shard, queries of a block; results of a query; factor of the integer components.
SHARD, BLOCK, K, SCALE = 4096, 1024, 10, 1024
#: Vectors of a shard that are traversed at once.
_STEP = 1024


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the floor of each scaled component of the vectors that take part."""
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = wide.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    return usable.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows, the short ones filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _shards(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, rows = part.column("vec_id").to_numpy().astype(np.int64), _matrix(part.column("vector"))
                cells = [pa.array([v], t) for v, t in ((ids.tobytes(), pa.binary()), (rows.tobytes(), pa.binary()), (rows.shape[1], pa.int32()))]
                yield pa.record_batch(cells, names=["ids", "cells", "width"])

    return pack


def _unpacked(ids: bytes, cells: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(cells, np.int64).reshape(len(names), width)


def _product(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """rows @ query, by way of doubles where those are exact."""
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64) if largest < 2**53 else rows @ query


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _traversed(query: np.ndarray, rows: np.ndarray, high: np.ndarray, low: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the rows that may score ``least`` or more; all rows if there is no such bound yet."""
    if least is None:
        return np.arange(len(rows)), _product(rows, query)
    bound = np.where(query >= 0, query * high, query * low)
    order = np.argsort(bound, kind="stable")
    # the weakest terms: even all together with no essential posting they stay below the threshold
    weak = np.searchsorted(np.cumsum(np.maximum(bound[order], 0)), least)
    essential, other = order[weak:], order[:weak]
    part = _product(rows[:, essential], query[essential]) if len(essential) else np.zeros(len(rows), np.int64)
    alive = np.flatnonzero(part + bound[other].sum() >= least)
    step = max(1, len(other) // 3)
    for at in range(len(other), 0, -step):
        # probe the strongest of the rest first, and drop what cannot compete any more
        probed, rest = other[max(0, at - step) : at], other[: max(0, at - step)]
        part[alive] += _product(rows[np.ix_(alive, probed)], query[probed])
        alive = alive[part[alive] + bound[rest].sum() >= least]
    return alive, part[alive]


def _searched(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows = _unpacked(row["ids"], row["cells"], row["width"])
                names, queries = _unpacked(row["query_ids"], row["query_cells"], row["query_width"])
                width = max(rows.shape[1], queries.shape[1])
                rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
                queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                steps = [(rows[a : a + _STEP].max(0), rows[a : a + _STEP].min(0), a) for a in range(0, len(rows), _STEP)]
                found = []
                for name, query in zip(names.tolist(), queries):
                    top_ids, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    for high, low, a in steps:
                        least = int(top[-1]) if len(top) == k else None
                        at, scores = _traversed(query, rows[a : a + _STEP], high, low, least)
                        other = ids[a + at] != name
                        top_ids, top = _best(np.append(top_ids, ids[a + at][other]), np.append(top, scores[other]), k)
                    found.append((np.full(len(top), name), top_ids, top))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
                yield pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of ``vectors`` for each row of ``queries``."""
    packed = "ids binary, cells binary, width int"
    shards = materialise(integers(vectors, scale).mapInArrow(_shards(SHARD), packed), "shards")
    blocks = integers(queries, scale).repartition(F.pmod(F.xxhash64("vec_id"), F.lit(64))).mapInArrow(_shards(BLOCK), packed)
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    numbers = blocks.agg(F.collect_list("block").alias("all"))  # one number for each thousand queries
    wanted = numbers.first()["all"]
    if not wanted:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    met = shards.withColumn("block", F.explode(F.array(*[F.lit(b) for b in wanted])))
    named = blocks.select("block", F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"), F.col("width").alias("query_width"))
    best = met.join(named, "block").drop("block").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
