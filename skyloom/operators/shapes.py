"""Shapes around points: convex hulls, hulls of few corners, least rotated rectangles.

Hulls are made where the points lie: each task turns the points of a group that
it reads into a chain, chains of a group meet in buckets, and buckets halve
their number until one is left.  What moves is corners, not points.  Corners
run counter-clockwise from the lowest left one, the first repeated at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators.scale import split_join
from skyloom.session import materialise

#: Buckets of a group in the first round of merging, and what each further round divides them by.
BUCKETS, FEWER = 64, 8


def _turn(ox: float, oy: float, ax: float, ay: float, bx: float, by: float) -> float:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def hull_corners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the convex hull by two monotone chains; points on its edges are no corners."""
    points = sorted(set(zip(x.tolist(), y.tolist())))
    if len(points) < 3:
        return tuple(np.array(c, float) for c in zip(*points)) if points else (np.zeros(0), np.zeros(0))

    def chain(run: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and _turn(*out[-2], *out[-1], *p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    corners = chain(points) + chain(points[::-1])
    return tuple(np.array(c, float) for c in zip(*corners))


def _keyed(rows: pd.DataFrame, groups: list[str], columns: dict) -> pd.DataFrame:
    """``columns`` with the group of ``rows``, all of one group, whose missing texts stay missing texts."""
    n = len(next(iter(columns.values())))
    keys = {}
    for g in groups:
        key = rows[g].iloc[0]
        text = rows[g].dtype == object
        keys[g] = pd.Series([None if text and pd.isna(key) else key] * n, dtype=rows[g].dtype)
    return pd.DataFrame({**keys, **columns})


def _chains(groups: list[str]):
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, own in batch.groupby(groups, dropna=False, sort=False):
                x, y = hull_corners(own["x"].to_numpy(), own["y"].to_numpy())
                yield _keyed(own, groups, {"x": x, "y": y})

    return local


def convex_hulls(points: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """groups and ``ring``, an array of (x, y): the hull of each group's points."""
    groups = list(groups)
    rows = points.select(*groups, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    schema = rows.schema
    rows = materialise(rows.mapInPandas(_chains(groups), schema), "chains")
    buckets = BUCKETS
    while buckets > 1:
        # the hull of any bucket keeps the corners of the whole that are in it
        dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64("x", "y"), F.lit(buckets)))
        merged = dealt.groupBy(*groups, "__bucket").applyInPandas(_merged(groups), schema)
        rows, buckets = merged, buckets // FEWER
    return rows.groupBy(*groups).applyInPandas(_ring(groups), ", ".join([*_ddl(rows, groups), "ring array<struct<x:double,y:double>>"]))


def _ddl(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def _merged(groups: list[str]):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = hull_corners(rows["x"].to_numpy(), rows["y"].to_numpy())
        return _keyed(rows, groups, {"x": x, "y": y})

    return merge


def _ring(groups: list[str]):
    def close(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = hull_corners(rows["x"].to_numpy(), rows["y"].to_numpy())
        ring = [{"x": a, "y": b} for a, b in zip([*x, x[0]], [*y, y[0]])]
        return _keyed(rows, groups, {"ring": [ring]})

    return close


def _sides(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return x, y, np.roll(x, -1) - x, np.roll(y, -1) - y


def least_rectangle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Area, long and short side of the least rectangle around corners: one of its sides lies on an edge of the hull."""
    if len(x) < 3:
        span = math.hypot(x[-1] - x[0], y[-1] - y[0]) if len(x) else 0.0
        return 0.0, span, 0.0
    x0, y0, dx, dy = _sides(x, y)
    length = np.hypot(dx, dy)
    along = (x[None, :] * dx[:, None] + y[None, :] * dy[:, None]) / length[:, None]
    across = ((y[None, :] - y0[:, None]) * dx[:, None] - (x[None, :] - x0[:, None]) * dy[:, None]) / length[:, None]
    width, height = along.max(1) - along.min(1), across.max(1)
    best = int((width * height).argmin())
    return float(width[best] * height[best]), float(max(width[best], height[best])), float(min(width[best], height[best]))


def fewer_corners(x: np.ndarray, y: np.ndarray, corners: int) -> tuple[np.ndarray, np.ndarray]:
    """A convex shape of at most ``corners`` corners (three at least) that holds the hull.

    The edge goes whose neighbours, made longer until they meet, add the least area.
    """
    x, y = x.copy(), y.copy()
    while len(x) > max(3, corners):
        n = len(x)
        best = None
        for i in range(n):
            # edge i runs from corner i to i + 1; its neighbours from i - 1 and to i + 2
            a, b, c, d = ((i + k) % n for k in (-1, 0, 1, 2))
            ux, uy, vx, vy = x[b] - x[a], y[b] - y[a], x[c] - x[d], y[c] - y[d]
            cross = ux * vy - uy * vx
            if cross >= -1e-15 * (abs(ux * vy) + abs(uy * vx)):
                continue  # the neighbours do not meet on this side
            t = ((x[c] - x[b]) * vy - (y[c] - y[b]) * vx) / cross
            px, py = x[b] + t * ux, y[b] + t * uy
            added = abs((px - x[b]) * (y[c] - y[b]) - (py - y[b]) * (x[c] - x[b])) / 2
            if t >= 0 and (best is None or added < best[0]):
                best = (added, b, c, px, py)
        if best is None:
            break
        _, b, c, px, py = best
        x[b], y[b] = px, py
        x, y = np.delete(x, c), np.delete(y, c)
    return x, y


def _corners(ring: list) -> tuple[np.ndarray, np.ndarray]:
    flat = np.array([(p["x"], p["y"]) for p in ring[:-1]], float).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def rectangle_of(ring: Column) -> Column:
    """Struct of area, long and short: the least rotated rectangle of a hull."""

    @F.pandas_udf("area double, long double, short double")
    def around(rings: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([least_rectangle(*_corners(r)) for r in rings], columns=["area", "long", "short"])

    return around(ring)


def simplified(ring: Column, corners: int) -> Column:
    """The hull with few corners, as a closed ring."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def reduce(rings: pd.Series) -> pd.Series:
        out = []
        for r in rings:
            x, y = fewer_corners(*_corners(r), corners)
            out.append([{"x": a, "y": b} for a, b in zip([*x, x[0]], [*y, y[0]])])
        return pd.Series(out)

    return reduce(ring)


def in_hull(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a convex ring or on its edge: it is to the right of no edge."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.forall(
        edges, lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"]) >= 0
    )


def points_in_hulls(points: DataFrame, hulls: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Every point once for each hull (its columns and ``ring``) that holds it; hulls register the cells of their boxes."""
    box = geo.rings_bbox(F.array("ring"))

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / F.lit(cell)), F.floor(high / F.lit(cell))))

    placed = hulls.withColumn("__cx", cells(box["x0"], box["x1"])).withColumn("__cy", cells(box["y0"], box["y1"]))
    seen = points.withColumns({"__cx": F.floor(F.col(x) / F.lit(cell)), "__cy": F.floor(F.col(y) / F.lit(cell))})
    return split_join(seen, placed, ["__cx", "__cy"]).where(in_hull(F.col(x), F.col(y), F.col("ring"))).drop("__cx", "__cy")
