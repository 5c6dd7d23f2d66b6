"""Mutual information of two columns from distances to nearest neighbours.

Both columns are scaled to unit deviation.  For every row the distance to its
k-th neighbour is taken in the larger of the two coordinate differences, then
the rows closer than that in either column alone are counted; the estimate is
digamma(N) + digamma(k) less the mean digammas of the two counts, at least 0.

Equal rows are one point with a weight.  Points are dealt out by rank, into
strips along x and tiles of about ``TILE`` points along y, so crowded and empty
regions give tiles of one size.  A tile finds the nearest neighbours among its
own points, each looking around itself first; a point whose distance reaches over the tile's box asks only the
tiles that it reaches, and the nearest of all answers counts.  Rows within a
distance in one column are the difference of two ranks, found for all points by
one sort.  No pair is formed beyond a tile, and a hot value is one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.ranks import number, ordered_totals
from skyloom.operators.scale import enrich
from skyloom.session import materialise

#: Points of a tile; strips at most; distances formed at once; points of a tile on either side that a query looks at first.
TILE, STRIPS, AT_ONCE, VIEW = 2000, 2048, 4_000_000, 64


def digamma(x: Column) -> Column:
    """For x of 1 and more: the asymptotic series six steps up, and the recurrence back."""
    x = x.cast("double")
    z = x + F.lit(6.0)
    inverse = F.lit(1.0) / (z * z)
    tail = inverse * (F.lit(1 / 12) - inverse * (F.lit(1 / 120) - inverse * (F.lit(1 / 252) - inverse * (F.lit(1 / 240) - inverse * F.lit(1 / 132)))))
    steps = sum((F.lit(1.0) / (x + F.lit(float(j))) for j in range(1, 6)), F.lit(1.0) / x)
    return F.log(z) - F.lit(0.5) / z - tail - steps


def _nearest(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances of each query to the points, ascending, infinite where there are fewer.

    Along the column of more different values, queries next to each other look
    at the points around them.  Points left out are at least as far as the
    first of them on either side; a query whose k-th distance is greater than
    that asks again, with a wider view, at last of all points.
    """
    if len(np.unique(px)) > len(np.unique(py)):
        px, py, qx, qy = py, px, qy, qx
    order = np.argsort(py, kind="stable")
    px, py = px[order], py[order]
    out = np.full((len(qx), k), np.inf)
    asking, view = np.argsort(qy, kind="stable"), VIEW
    while len(asking):
        step = max(1, min(VIEW, AT_ONCE // max(1, len(px))))
        left = []
        for at in range(0, len(asking), step):
            own = asking[at : at + step]
            low = max(0, int(np.searchsorted(py, qy[own[0]])) - view)
            high = min(len(py), int(np.searchsorted(py, qy[own[-1]], "right")) + view)
            d = np.maximum(np.abs(qx[own, None] - px[None, low:high]), np.abs(qy[own, None] - py[None, low:high]))
            found = np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)
            out[own, : found.shape[1]] = found
            beyond = np.minimum(qy[own] - py[low - 1] if low else np.inf, py[high] - qy[own] if high < len(py) else np.inf)
            left.append(own[out[own, k - 1] > beyond])
        asking, view = np.concatenate(left), view * 8
    return out


def _tiled(points: DataFrame, total: int) -> DataFrame:
    """``points`` (id, x, y, n) with strip and tile, written."""
    tiles = max(1, -(-total // TILE))
    per_strip = max(TILE * round(tiles**0.5), -(-total // STRIPS))
    values = points.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    strips = ordered_totals(values, [], "x", ["m"]).select("x", F.floor(F.col("m_before") / per_strip).alias("strip"))
    placed = enrich(points, strips, ["x"]).withColumns({"one": F.lit(1), "place": F.struct("y", "id")})
    dealt = ordered_totals(placed, ["strip"], "place", ["one"])
    return materialise(dealt.select("id", "x", "y", "n", "strip", F.floor(F.col("one_before") / TILE).alias("tile")), "tiles")


def _own(k: int):
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        copies = np.minimum(rows["n"].to_numpy(), k + 1)
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        # the row itself is the first of its distances
        found = _nearest(np.repeat(x, copies), np.repeat(y, copies), x, y, k + 1)[:, 1:]
        return pd.DataFrame({"id": rows["id"], "x": x, "y": y, "strip": rows["strip"], "tile": rows["tile"], "found": list(found)})

    return find


def _visited(k: int):
    def find(points: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(visitors):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "found": pd.Series([], dtype=object)})
        copies = np.minimum(points["n"].to_numpy(), k)
        px, py = np.repeat(points["x"].to_numpy(), copies), np.repeat(points["y"].to_numpy(), copies)
        found = _nearest(px, py, visitors["x"].to_numpy(), visitors["y"].to_numpy(), k)
        return pd.DataFrame({"id": visitors["id"].to_numpy(), "found": list(found)})

    return find


def _distances(tiled: DataFrame, k: int) -> DataFrame:
    """id and the distance to the k-th neighbour, infinite when there is none."""
    on = ["strip", "tile"]
    own = tiled.groupBy(*on).applyInPandas(_own(k), "id long, x double, y double, strip long, tile long, found array<double>")
    own = materialise(own, "own-distances")
    boxes = tiled.groupBy(*on).agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    strips = boxes.groupBy("strip").agg(
        F.min("x0").alias("from"), F.collect_list(F.struct("tile", "x0", "x1", "y0", "y1")).alias("boxes")
    )
    strips = materialise(strips, "strips")
    starts = sorted((r["from"], r["strip"]) for r in strips.select("from", "strip").collect())  # at most STRIPS rows
    cuts = np.array([a for a, _ in starts])
    names = np.array([b for _, b in starts], np.int64)

    @F.pandas_udf("array<long>")
    def reached(x: pd.Series, reach: pd.Series) -> pd.Series:
        low = np.maximum(np.searchsorted(cuts, (x - reach).to_numpy(), "right") - 1, 0)
        high = np.searchsorted(cuts, (x + reach).to_numpy(), "right")
        return pd.Series([names[a:b] for a, b in zip(low, high)])

    last = F.element_at("found", -1)
    asking = own.select("id", "x", "y", F.col("strip").alias("home"), F.col("tile").alias("room"), last.alias("reach"))
    # a distance beyond all is as good as infinite, and adds up
    far = F.least(F.col("reach"), F.lit(1e300))
    asking = asking.where("reach > 0").withColumn("reach", far).withColumn("strip", F.explode(reached("x", "reach")))

    def touched(box: Column) -> Column:
        near = (box["x0"] <= F.col("x") + F.col("reach")) & (box["x1"] >= F.col("x") - F.col("reach"))
        near &= (box["y0"] <= F.col("y") + F.col("reach")) & (box["y1"] >= F.col("y") - F.col("reach"))
        return near & ~((F.col("strip") == F.col("home")) & (box["tile"] == F.col("room")))

    visits = asking.join(strips, "strip").select("id", "x", "y", "strip", F.explode(F.filter("boxes", touched)).alias("box"))
    visits = visits.select("id", "x", "y", "strip", F.col("box.tile").alias("tile"))
    answers = tiled.select("x", "y", "n", *on).groupBy(*on).cogroup(visits.groupBy(*on)).applyInPandas(_visited(k), "id long, found array<double>")
    every = own.select("id", "found").unionByName(answers)
    kth = F.get(F.array_sort(F.flatten(F.collect_list("found"))), F.lit(k - 1))
    return every.groupBy("id").agg(kth.alias("reach"))


def _ordered(v: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, and back."""
    bits = (v + 0.0).view(np.int64) if v.dtype == np.float64 else v
    flipped = np.where(bits < 0, np.int64(-(2**63)) - bits, bits)
    return flipped if v.dtype == np.float64 else flipped.view(np.float64)


def _outermost(v: np.ndarray, reach: np.ndarray, sign: int) -> np.ndarray:
    """The number farthest from v on one side whose rounded difference is below the reach, by bisection over all doubles."""
    inside, outside = _ordered(v), _ordered(v + sign * 2 * reach)
    for _ in range(64):
        middle = (inside & outside) + ((inside ^ outside) >> 1)
        near = np.abs(_ordered(middle) - v) < reach
        inside, outside = np.where(near, middle, inside), np.where(near, outside, middle)
    return np.where(reach == 0, v, _ordered(inside))


def _bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and last numbers that are closer than the reach, in both columns; the value itself when the reach is 0."""
    for rows in batches:
        reach = rows["reach"].to_numpy()
        parts = []
        for i, c in enumerate("xy"):
            for sign in (-1, 1):
                at = _outermost(rows[c].to_numpy(), reach, sign)
                parts.append(pd.DataFrame({"i": i, "v": at, "side": sign, "id": rows["id"], "n": rows["n"], "w": 0}))
        yield pd.concat(parts)


def neighbour_information(df: DataFrame, x: str, y: str, k: int = 3) -> float | None:
    """The estimate in nats over rows complete in both columns; None for k rows or fewer."""
    pairs = df.select(number(x).alias("x"), number(y).alias("y")).where("x is not null and y is not null")
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
    total = row["n"]
    if total <= k:
        return None
    if not row["sx"] or not row["sy"]:
        return 0.0
    scaled = pairs.select((F.col("x") / F.lit(row["sx"])).alias("x"), (F.col("y") / F.lit(row["sy"])).alias("y"))
    points = scaled.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id())
    points = materialise(points, "points")
    tiled = _tiled(points, points.count())
    reached = materialise(points.join(_distances(tiled, k), "id"), "reached")
    asked = reached.mapInPandas(_bounds, "i int, v double, side int, id long, n long, w long")
    nothing = {"side": F.lit(0), "id": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}
    held = [points.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("w")).withColumns({"i": F.lit(i), **nothing}) for i, c in enumerate("xy")]
    rows = asked.unionByName(held[0]).unionByName(held[1]).withColumn("place", F.struct("v", "side"))
    counted = ordered_totals(rows, ["i"], "place", ["w"]).where("id is not null")
    within = counted.groupBy("id", "i", "n").agg(F.sum(F.col("side") * F.col("w_before")).alias("m"))
    spread = within.agg(F.sum(F.col("n") * digamma(F.col("m")))).first()[0]
    ends = pairs.sparkSession.range(1).select(digamma(F.lit(total)).alias("a"), digamma(F.lit(k)).alias("b")).first()
    return max(0.0, ends["a"] + ends["b"] - spread / total)
