"""Moran's I of tile residuals on a hexagonal grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geo import HEX_NEIGHBOURS
from skyloom.operators.scale import numbered
from skyloom.session import materialise


def neighbour_edges(tiles: DataFrame, tile: str = "tile") -> DataFrame:
    """(src, dst) for every pair of present tiles that touch.

    ``tiles`` has the key and axial ``q``, ``r``; each tile names its six
    neighbours and an equi-join keeps those that exist.
    """
    offsets = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in HEX_NEIGHBOURS])
    asked = tiles.select(F.col(tile).alias("src"), "q", "r", F.explode(offsets).alias("o")).select(
        "src", (F.col("q") + F.col("o.dq")).alias("q"), (F.col("r") + F.col("o.dr")).alias("r")
    )
    return asked.join(tiles.select(F.col(tile).alias("dst"), "q", "r"), ["q", "r"]).select("src", "dst")


#: Tiles whose residuals every task gets, eight bytes each; more are permuted by a shuffle.
HELD_TILES = 2_000_000


def permutation(seed: int, number: int, k: int) -> np.ndarray:
    """Which place's residual each place gets; number 0 is the order as observed."""
    return np.random.default_rng([seed, number]).permutation(k) if number else np.arange(k)


def _held_sums(placed: DataFrame, edges: DataFrame, k: int, n_perm: int, seed: int) -> DataFrame:
    """(perm, i) for every permutation: each task adds up its own edges, and nothing but sums is shuffled."""
    found = placed.select("place", "z").toPandas()  # at most HELD_TILES rows
    values = np.zeros(k)
    values[found["place"].to_numpy()] = found["z"].to_numpy()
    ends = {c: placed.select(F.col("tile").alias(c), F.col("place").alias(f"{c}_place")) for c in ("src", "dst")}
    placed_edges = edges.join(ends["src"], "src").join(ends["dst"], "dst").select("src_place", "dst_place", "w")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [b.to_numpy() for b in batches if len(b)]
        if own:
            src, dst, w = np.concatenate(own).T
            src, dst, out = src.astype(np.int64), dst.astype(np.int64), np.zeros(n_perm + 1)
            for p in range(n_perm + 1):
                v = values[permutation(seed, p, k)]
                out[p] = (w * v[src] * v[dst]).sum()
            yield pd.DataFrame({"perm": np.arange(n_perm + 1), "i": out})

    return placed_edges.mapInPandas(sums, "perm int, i double").groupBy("perm").agg(F.sum("i").alias("i"))


def _shuffled_sums(z: DataFrame, placed: DataFrame, edges: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """The same for any number of tiles: permutations are hash orders, met with the edges by joins."""
    shuffled = (
        z.select("tile", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm"))
        .withColumn("h", F.xxhash64("tile", "perm", F.lit(seed)))
    )
    drawn = numbered(shuffled, ["perm"], "h", "tile", parts=16).join(placed.select("place", "z"), "place").select("perm", "tile", "z")
    observed = z.select(F.lit(0).alias("perm"), "tile", "z")
    assigned = materialise(observed.unionByName(drawn), "permutations")
    left = assigned.select("perm", F.col("tile").alias("src"), F.col("z").alias("zi"))
    right = assigned.select("perm", F.col("tile").alias("dst"), F.col("z").alias("zj"))
    return (
        left.join(edges, "src").join(right, ["perm", "dst"])
        .groupBy("perm").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("i"))
    )


def morans_i(residuals: DataFrame, n_perm: int = 999, seed: int = 42) -> DataFrame:
    """One row: I, E[I], permutation p, tiles, edges.

    ``residuals`` has tile, q, r and value.  Weights are one per neighbour,
    row-standardised.  A permutation deals the residuals out to the tiles anew;
    all permutations run as one job over the edges.
    """
    k_row = residuals.agg(F.count(F.lit(1)), F.avg("value")).first()
    k, mean = int(k_row[0]), k_row[1]
    spark = residuals.sparkSession
    if k < 2:
        return spark.createDataFrame(
            [(None, None, 1.0, k, 0)],
            "morans_i double, expected_i double, p_value double, n_tiles long, n_edges long",
        )
    z = materialise(
        residuals.select("tile", "q", "r", (F.col("value") - F.lit(mean)).alias("z"),
                         F.xxhash64("tile").alias("h")),
        "residuals",
    )
    edges = neighbour_edges(z).join(
        neighbour_edges(z).groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src"
    ).select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("w"))
    edges = materialise(edges, "edges")
    weight, n_edges = edges.agg(F.sum("w"), F.count(F.lit(1))).first()
    expected = -1.0 / (k - 1)
    if not n_edges:
        return spark.createDataFrame(
            [(0.0, expected, 1.0, k, 0)],
            "morans_i double, expected_i double, p_value double, n_tiles long, n_edges long",
        )
    ss = max(z.agg(F.sum(F.col("z") * F.col("z"))).first()[0], 1e-14)
    placed = materialise(numbered(z.select("tile", "z", "h"), [], "h", "tile").select("tile", "place", "z"), "places")
    sums = _held_sums(placed, edges, k, n_perm, seed) if k <= HELD_TILES else _shuffled_sums(z, placed, edges, n_perm, seed)
    stats = sums.select("perm", (F.col("i") * F.lit(k / weight / ss)).alias("i"))
    i_obs = F.max(F.when(F.col("perm") == 0, F.col("i")))
    spread = stats.agg(i_obs.alias("morans_i"), F.collect_list("i").alias("all"))  # n_perm + 1 numbers
    hits = F.size(F.filter("all", lambda v: F.abs(v) >= F.abs(F.col("morans_i"))))
    return spread.select(
        "morans_i", F.lit(expected).alias("expected_i"),
        # the observed value itself supplies the +1
        (hits / F.lit(float(n_perm + 1))).alias("p_value"),
        F.lit(k).cast("long").alias("n_tiles"), F.lit(n_edges).cast("long").alias("n_edges"),
    )
