"""Share of a disk around a location that polygons of a class cover.

Polygons become bit pictures on a fine sub-grid, one per layer and tile.  Union
of polygons is a bitwise or, the overlap of a row with a disk row is a
difference of two row sums; both are integers, so results do not depend on the
order of work.  Polygons go to the tiles that they touch and are drawn there,
so what is shuffled follows polygons and tiles, not the rows that they cross.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions import geo
from skyloom.operators.scale import split_join
from skyloom.session import materialise


@dataclass(frozen=True)
class Grid:
    """Output grid with a supersampled sub-grid; cell (0, 0) centres on the origin."""

    resolution_m: float = 15.0
    supersample: int = 4
    lon: tuple[float, float] = geo.STUDY_LON
    lat: tuple[float, float] = geo.STUDY_LAT

    @property
    def step_lon(self) -> float:
        return self.resolution_m * geo.LON_DEG_PER_M

    @property
    def step_lat(self) -> float:
        return self.resolution_m * geo.LAT_DEG_PER_M

    @property
    def lon0(self) -> float:  # one cell of border
        return self.lon[0] - self.step_lon

    @property
    def lat0(self) -> float:
        return self.lat[0] - self.step_lat

    @property
    def n_lon(self) -> int:
        return math.ceil((self.lon[1] - self.lon[0]) / self.step_lon) + 3

    @property
    def n_lat(self) -> int:
        return math.ceil((self.lat[1] - self.lat[0]) / self.step_lat) + 3

    def snap(self, lon="longitude", lat="latitude") -> dict[str, Column]:
        """Nearest grid point, halves to even, clamped to the grid."""

        def index(value: str, origin: float, step: float, n: int) -> Column:
            i = F.rint((F.col(value) - F.lit(origin)) / F.lit(step)).cast("int")
            return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))

        return {
            "ix": index(lon, self.lon0, self.step_lon, self.n_lon),
            "iy": index(lat, self.lat0, self.step_lat, self.n_lat),
        }

    def kernel(self, radius_m: float) -> dict[int, list[tuple[int, int]]]:
        """Disk weights in sixteenths, as (half width, count) steps per row.

        A sub-cell's weight is the share of its 4 x 4 sample points inside the
        disk.  Weights fall off to both sides of a row, so a row is a stack of
        centred intervals: ``count`` sixteenths apply to all columns within the
        half width.
        """
        ss = self.supersample
        sub = (self.step_lon / ss, self.step_lat / ss)
        rad = (radius_m * geo.LON_DEG_PER_M, radius_m * geo.LAT_DEG_PER_M)
        reach = [math.ceil(r / s) + 1 for r, s in zip(rad, sub)]
        offsets = [(i + 0.5) / 4 - 0.5 for i in range(4)]

        def weight(dx: int, dy: int) -> int:
            return sum(
                (((dx + ox) * sub[0]) / rad[0]) ** 2 + (((dy + oy) * sub[1]) / rad[1]) ** 2 <= 1.0
                for ox in offsets
                for oy in offsets
            )

        rows = {}
        for dy in range(-reach[1], reach[1] + 1):
            weights = [weight(dx, dy) for dx in range(reach[0] + 1)]
            steps: dict[int, int] = {}
            for level in range(1, max(weights) + 1):
                half = max(i for i, w in enumerate(weights) if w >= level)
                steps[half] = steps.get(half, 0) + 1
            if steps:
                rows[dy] = sorted(steps.items())
        return rows


def kernel_total(rows: dict[int, list[tuple[int, int]]]) -> int:
    return sum(n * (2 * half + 1) for steps in rows.values() for half, n in steps)


def polygon_runs(polygons: DataFrame, layer: list[str], polygon_id: str, grid: Grid,
                 reach: int = 256) -> DataFrame:
    """Sub-grid runs (y, xa, xb) whose cell centres lie inside each polygon.

    ``reach`` rows and columns are kept around the grid, as many as disks reach.

    Every ring edge is cut at the sub-rows it crosses; crossings of one polygon
    and row, in order, bound the runs (even-odd, so holes work).  Rows of one id
    and layer are one polygon.  Polygons are shuffled, their many crossings are not.
    """
    frame = (grid.lon0, grid.lat0, grid.step_lon / grid.supersample, grid.step_lat / grid.supersample)
    rows = (-reach, grid.n_lat * grid.supersample + reach)
    cols = (-reach, grid.n_lon * grid.supersample + reach)
    names = list(dict.fromkeys([polygon_id, *layer]))
    schema = T.StructType([*[polygons.schema[c] for c in names], *[T.StructField(c, T.IntegerType()) for c in ("y", "xa", "xb")]])
    return _whole(polygons, names).mapInArrow(_runs_of(names, frame, rows, cols), schema)


def _whole(polygons: DataFrame, names: list[str]) -> DataFrame:
    """One row per polygon with all its rings."""
    rings = F.flatten(F.collect_list("rings")).alias("rings")
    return polygons.where(~F.exists("rings", lambda ring: ring.isNull())).groupBy(*names).agg(rings)


#: Crossings of edges and rows that are ordered at once; a polygon with more is taken whole.
CROSSINGS = 500_000


def _runs_of(keys: list[str], frame: tuple, rows: tuple[int, int], cols: tuple[int, int]):
    lon0, lat0, sub_lon, sub_lat = frame

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column("rings")
            ring = rings.flatten()
            x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in ring.flatten().flatten())
            sizes = ring.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.repeat(np.arange(len(rings)), rings.value_lengths().to_numpy(zero_copy_only=False)), sizes)
            of = np.repeat(np.arange(len(ring)), sizes)
            u, v = (x - lon0) / sub_lon, (y - lat0) / sub_lat
            at = np.flatnonzero(of[1:] == of[:-1])
            first = np.maximum(np.ceil(np.minimum(v[at], v[at + 1])), rows[0])
            last = np.minimum(np.ceil(np.maximum(v[at], v[at + 1])) - 1, rows[1])
            cut = first <= last
            at, first, counts = at[cut], first[cut].astype(np.int64), (last - first)[cut].astype(np.int64) + 1
            own, before = owner[at], np.append(0, np.cumsum(counts))
            low = 0
            while low < len(at):
                high = int(np.searchsorted(before, before[low] + CROSSINGS, "right")) - 1
                # a polygon's edges stay together
                high = int(np.searchsorted(own, own[high])) if high < len(at) else len(at)
                high = high if high > low else int(np.searchsorted(own, own[low], "right"))
                n = counts[low:high]
                row = np.arange(n.sum()) - np.repeat(before[low:high] - before[low] - first[low:high], n)
                u1, v1 = np.repeat(u[at[low:high]], n), np.repeat(v[at[low:high]], n)
                u2, v2 = np.repeat(u[at[low:high] + 1], n), np.repeat(v[at[low:high] + 1], n)
                cross = u1 + (row - v1) * (u2 - u1) / (v2 - v1)
                group = np.repeat(own[low:high], n) * (rows[1] - rows[0] + 1) + (row - rows[0])
                order = np.lexsort((cross, group))
                cross, group, row = cross[order], group[order], row[order]
                heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                place = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
                left = np.flatnonzero((place[:-1] % 2 == 0) & (group[1:] == group[:-1]))
                xa, xb = np.maximum(np.ceil(cross[left]), cols[0]), np.minimum(np.ceil(cross[left + 1]) - 1, cols[1])
                some = xa <= xb
                left = left[some]
                polygon = pa.array(group[left] // (rows[1] - rows[0] + 1))
                ends = [pa.array(c.astype(np.int32)) for c in (row[left], xa[some], xb[some])]
                yield pa.record_batch([*[batch.column(k).take(polygon) for k in keys], *ends], names=[*keys, "y", "xa", "xb"])
                low = high

    return runs


class _Disks:
    """The disks of some radii as flat arrays: row, half width and weight of every step, and the radius it belongs to."""

    def __init__(self, radii: list[float], grid: Grid) -> None:
        kernels = [grid.kernel(r) for r in radii]
        flat = [(dy, half, n, i) for i, rows in enumerate(kernels) for dy, steps in rows.items() for half, n in steps]
        self.dy, self.half, weight, own = (np.array(c, np.int64) for c in zip(*flat))
        self.weights = np.zeros((len(flat), len(radii)), np.int64)
        self.weights[np.arange(len(flat)), own] = weight
        self.totals = [kernel_total(k) for k in kernels]
        self.reach_y, self.reach_x = int(np.abs(self.dy).max()), int(self.half.max())

    def counts(self, sums: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Weighted cells of every disk (centres by radii) from row sums that begin with 0: two lookups a step."""
        rows = y[:, None] + self.dy[None, :]
        return (sums[rows, x[:, None] + self.half + 1] - sums[rows, x[:, None] - self.half]) @ self.weights


#: Targets along the side of a tile; pieces that one task draws.
TILE, PIECES = 64, 20_000


class _Tiles:
    """The sub-grid in squares of ``TILE`` targets, each with the margin that its disks reach."""

    def __init__(self, radii: list[float], grid: Grid) -> None:
        self.disks = disks = _Disks(radii, grid)
        self.ss, self.side = grid.supersample, TILE * grid.supersample
        self.height, self.width = self.side + 2 * disks.reach_y, self.side + 2 * disks.reach_x
        self.frame = (grid.lon0, grid.lat0, grid.step_lon / self.ss, grid.step_lat / self.ss)
        self.rows = (-disks.reach_y, grid.n_lat * self.ss + disks.reach_y)
        self.cols = (-disks.reach_x, grid.n_lon * self.ss + disks.reach_x)

    def corner(self, tx: int, ty: int) -> tuple[int, int]:
        return tx * self.side - self.disks.reach_x, ty * self.side - self.disks.reach_y


def _pieces(polygons: DataFrame, layer: list[str], polygon_id: str, targets: DataFrame, tiles: _Tiles) -> DataFrame:
    """(tx, ty, layer, rings) of every polygon in every tile that its box touches and that has targets.

    Rings are left as the edges that cross the rows of the tile, two points
    each: crossings of other rows and level edges bound no run in it.
    """
    lon0, lat0, sub_lon, sub_lat = tiles.frame
    disks, side = tiles.disks, tiles.side

    def edges(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda p, q: F.array(p, q))

    def end(pick, c: str):
        """Of an edge the lower or higher end; null when it is not a number."""

        def value(e: Column) -> Column:
            v = pick(e[0][c], e[1][c])
            return F.when(~F.isnan(v), v)

        return value

    def crossing(e: Column) -> Column:
        known = e[0]["y"].isNotNull() & e[1]["y"].isNotNull() & ~F.isnan(e[0]["y"]) & ~F.isnan(e[1]["y"])
        return known & (e[0]["y"] != e[1]["y"])

    def span(low: Column, upto: Column, origin: float, step: float, reach: int, ends: tuple[int, int]) -> Column:
        """Tiles from one coordinate to another, a cell more on both sides, within the grid."""
        first, last = ((v - F.lit(origin)) / F.lit(step) for v in (low, upto))
        bounds = [F.greatest(F.lit(float(ends[0])), F.least(F.lit(float(ends[1])), v)) for v in (first - (reach + 1), last + (reach + 1))]
        return F.explode(F.sequence(*[F.floor(v / F.lit(float(side))).cast("int") for v in bounds]))

    whole = _whole(polygons, list(dict.fromkeys([polygon_id, *layer]))).select(
        F.to_json(F.struct(*layer)).alias("layer"), F.filter(F.flatten(F.transform("rings", edges)), crossing).alias("edges")
    ).where(F.size("edges") > 0)
    boxed = whole.withColumns({
        f"{c}{i}": outermost(F.transform("edges", end(pick, c)))
        for c in "xy" for i, (outermost, pick) in enumerate(((F.array_min, F.least), (F.array_max, F.greatest)))
    })
    asked = targets.select(*[F.floor(F.col(c) / TILE).cast("int").alias(t) for c, t in (("ix", "tx"), ("iy", "ty"))]).distinct()
    placed = boxed.withColumn("tx", span(F.col("x0"), F.col("x1"), lon0, sub_lon, disks.reach_x, tiles.cols))
    placed = placed.withColumn("ty", span(F.col("y0"), F.col("y1"), lat0, sub_lat, disks.reach_y, tiles.rows))
    south = F.lit(lat0) + (F.col("ty") * side - disks.reach_y - 1) * F.lit(sub_lat)
    north = south + F.lit((tiles.height + 2) * sub_lat)
    near = F.filter("edges", lambda e: (end(F.greatest, "y")(e) >= south) & (end(F.least, "y")(e) <= north))
    return placed.join(asked, ["tx", "ty"], "left_semi").select("tx", "ty", "layer", near.alias("rings")).where(F.size("rings") > 0)


def _painted(tiles: _Tiles):
    """Pieces in order of tile and layer to the cells they cover: one packed picture for each tile and layer of a batch."""
    height, width = tiles.height, tiles.width

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tx, ty = (batch.column(c).to_numpy() for c in ("tx", "ty"))
            layer = batch.column("layer").dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, (np.diff(tx) != 0) | (np.diff(ty) != 0)))
            for low, high in zip(starts, np.append(starts[1:], len(tx))):
                x0, y0 = tiles.corner(int(tx[low]), int(ty[low]))
                rows = (max(y0, tiles.rows[0]), min(y0 + height - 1, tiles.rows[1]))
                cols = (max(x0, tiles.cols[0]), min(x0 + width - 1, tiles.cols[1]))
                own = pa.record_batch([pa.array(np.arange(low, high)), batch.column("rings").slice(low, high - low)], names=["at", "rings"])
                pictures: dict[int, np.ndarray] = {}
                for runs in _runs_of(["at"], tiles.frame, rows, cols)(iter([own])):
                    at, y, xa, xb = (runs.column(i).to_numpy().astype(np.int64) for i in range(4))
                    of = layer[at]
                    line = (y - y0) * (width + 1) - x0
                    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
                    for a, b in zip(heads, np.append(heads[1:], len(of))):
                        # begins less ends, added up along each row, are the polygons over a cell
                        size = height * (width + 1)
                        depth = np.bincount(line[a:b] + xa[a:b], minlength=size) - np.bincount(line[a:b] + xb[a:b] + 1, minlength=size)
                        held = np.packbits(depth.reshape(height, width + 1).cumsum(1)[:, :width] > 0)
                        key = int(of[a])
                        pictures[key] = pictures[key] | held if key in pictures else held
                if pictures:
                    first = {int(k): low + i for k, i in zip(*np.unique(layer[low:high], return_index=True))}
                    named = batch.column("layer").take(pa.array([first[k] for k in pictures]))
                    places = [pa.array(np.full(len(pictures), c[low], np.int32)) for c in (tx, ty)]
                    yield pa.record_batch([*places, named, pa.array([v.tobytes() for v in pictures.values()], pa.binary())], names=["tx", "ty", "layer", "cells"])

    return paint


def _tile_fractions(tiles: _Tiles, names: list[str]):
    disks, height, width = tiles.disks, tiles.height, tiles.width

    def fractions(key: tuple, targets: pd.DataFrame, pictures: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(targets):
            x0, y0 = tiles.corner(key[0], key[1])
            ix, iy = targets["ix"].to_numpy(), targets["iy"].to_numpy()
            sums = np.zeros((height, width + 1), np.int32)
            for layer, own in pictures.groupby("layer", sort=False)["cells"]:
                held = np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in own])
                np.cumsum(np.unpackbits(held, count=height * width).reshape(height, width), axis=1, dtype=np.int32, out=sums[:, 1:])
                counts = disks.counts(sums, ix * tiles.ss - x0, iy * tiles.ss - y0)
                hit = np.flatnonzero(counts.any(1))
                found.append((ix[hit], iy[hit], np.full(len(hit), layer, object), np.minimum(1.0, counts[hit] / np.array(disks.totals, float))))
        if not found:
            return pd.DataFrame({c: [] for c in ("ix", "iy", "layer", *names)}).astype({"layer": object})
        columns = [np.concatenate(c) for c in zip(*found)]
        return pd.DataFrame({"ix": columns[0], "iy": columns[1], "layer": columns[2], **dict(zip(names, columns[3].T))})

    return fractions


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def layer_pictures(polygons: DataFrame, layer: list[str], polygon_id: str, targets: DataFrame, tiles: _Tiles) -> DataFrame:
    """Union of polygons per layer: (tx, ty, layer, cells), the cells of a tile as packed bits.

    Polygons travel, not their rows: pieces are dealt out in order of tiles, a
    crowded tile over several tasks, and each task adds up the runs of a layer
    in the tile where they lie.  So there are as many pictures as layers in
    tiles, and one more at each cut between tasks or batches.
    """
    pieces = materialise(_pieces(polygons, layer, polygon_id, targets, tiles).withColumn("n", F.monotonically_increasing_id()), "pieces")
    # few bytes make much work here, so the number of tasks follows the pieces
    tasks = max(_cores(pieces), -(-pieces.count() // PIECES))
    dealt = pieces.repartitionByRange(tasks, "ty", "tx", "n").sortWithinPartitions("ty", "tx", "layer").select("tx", "ty", "layer", "rings")
    return dealt.mapInArrow(_painted(tiles), "tx int, ty int, layer string, cells binary")


def coverage(polygons: DataFrame, layer: list[str], polygon_id: str, targets: DataFrame,
             radii: list[float], grid: Grid) -> DataFrame:
    """Covered share of the disk around each grid point, per layer and radius.

    ``targets`` holds distinct (ix, iy).  Output columns ``frac_<radius>``; rows
    exist only where some radius is touched.  Targets and pictures of layers
    meet in tiles of ``TILE`` by ``TILE`` targets; every step of every disk is a
    difference of two sums along a row.  What a tile holds is bounded by its
    area and the number of layers.
    """
    if polygon_id in layer:
        kernels = [grid.kernel(r) for r in radii]
        reach = max(max(abs(dy), *(h for h, _ in steps)) for k in kernels for dy, steps in k.items()) + 1
        return _polygon_fractions(polygons, layer, polygon_id, targets, radii, grid, reach)
    tiles = _Tiles(radii, grid)
    placed = targets.select("ix", "iy", F.floor(F.col("ix") / TILE).cast("int").alias("tx"), F.floor(F.col("iy") / TILE).cast("int").alias("ty"))
    pictures = layer_pictures(polygons, layer, polygon_id, targets, tiles)
    names = [f"frac_{int(r)}" for r in radii]
    schema = "ix int, iy int, layer string, " + ", ".join(f"{n} double" for n in names)
    met = [df.repartition(8 * _cores(df), "tx", "ty").groupBy("tx", "ty") for df in (placed, pictures)]
    found = met[0].cogroup(met[1]).applyInPandas(_tile_fractions(tiles, names), schema)
    kept = F.from_json("layer", T.StructType([polygons.schema[c] for c in layer]))
    return found.withColumn("layer", kept).select("ix", "iy", *[F.col("layer")[c].alias(c) for c in layer], *names)


#: Disks whose rows are looked up at once.
DISKS = 20_000


def _overlaps(names: list[str], radii: list[float], grid: Grid, reach: int):
    """Rows (names, rings, spots) to (ix, iy, names, fractions), from the runs of each polygon and sums of the disks' weights along a row."""
    kernels = [grid.kernel(r) for r in radii]
    dys = np.arange(-reach, reach + 1)
    # for every radius and row the weight of all columns up to a place, from one before the disk to its end
    upto = np.zeros((len(radii), len(dys), 2 * reach + 2), np.int64)
    for i, rows in enumerate(kernels):
        for dy, steps in rows.items():
            for half, n in steps:
                upto[i, dy + reach, reach + 1 - half : reach + 2 + half] += n
    upto = upto.cumsum(2)
    totals = [kernel_total(k) for k in kernels]
    ss = grid.supersample
    frame = (grid.lon0, grid.lat0, grid.step_lon / ss, grid.step_lat / ss)
    rows, cols = (-reach, grid.n_lat * ss + reach), (-reach, grid.n_lon * ss + reach)
    height = rows[1] - rows[0] + 1
    runs_of = _runs_of(["at"], frame, rows, cols)

    def fractions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.record_batch([pa.array(np.arange(len(batch))), batch.column("rings")], names=["at", "rings"])
            found = pa.Table.from_batches(runs_of(iter([numbered])), pa.schema([("at", pa.int64()), *[(c, pa.int32()) for c in ("y", "xa", "xb")]]))
            at, y, xa, xb = (found[c].to_numpy().astype(np.int64) for c in ("at", "y", "xa", "xb"))
            key = at * height + y - rows[0]
            order = np.argsort(key, kind="stable")
            key, xa, xb = key[order], xa[order], xb[order]
            spots = batch.column("spots")
            of = np.repeat(np.arange(len(batch)), spots.value_lengths().to_numpy(zero_copy_only=False))
            ix, iy = (c.to_numpy(zero_copy_only=False) for c in spots.flatten().flatten())
            for low in range(0, len(of), DISKS):
                own = slice(low, low + DISKS)
                row = iy[own].astype(np.int64)[:, None] * ss + dys[None, :]
                asked = np.where((row >= rows[0]) & (row <= rows[1]), of[own][:, None] * height + row - rows[0], -1).ravel()
                first, last = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
                n = last - first
                cell = np.repeat(np.arange(len(asked)), n)
                run = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                disk, line = np.divmod(cell, len(dys))
                x = ix[own].astype(np.int64)[disk] * ss
                a, b = (np.clip(v - x, -reach - 1, reach) + reach + 1 for v in (xa[run] - 1, xb[run]))
                size = len(ix[own])
                counts = [np.bincount(disk, u[line, b] - u[line, a], size) for u in upto]
                hit = np.flatnonzero(np.sum(counts, axis=0) > 0)
                shares = [pa.array(np.minimum(1.0, c[hit] / total)) for c, total in zip(counts, totals)]
                kept = [batch.column(c).take(pa.array(of[own][hit])) for c in names]
                yield pa.record_batch([pa.array(ix[own][hit]), pa.array(iy[own][hit]), *kept, *shares], names=["ix", "iy", *names, *[f"frac_{int(r)}" for r in radii]])

    return fractions


def _polygon_fractions(polygons: DataFrame, layer: list[str], polygon_id: str, targets: DataFrame, radii: list[float], grid: Grid, reach: int) -> DataFrame:
    """Disk fractions where every polygon is a layer of its own.

    Nothing has to be united, so no words are formed and no tile is laid out for
    a layer: a polygon meets the targets near its box, and the weights of each
    disk are read off at the ends of the polygon's runs.
    """
    centres = targets.select("ix", "iy").distinct().withColumns({
        "longitude": F.lit(grid.lon0) + F.col("ix") * F.lit(grid.step_lon), "latitude": F.lit(grid.lat0) + F.col("iy") * F.lit(grid.step_lat),
    })
    margin = (reach + 1) * grid.resolution_m / grid.supersample
    whole = _whole(polygons, layer)
    near = _near_boxes(whole, layer, centres, ["ix", "iy"], margin, 500.0)
    spots = near.groupBy(*layer).agg(F.collect_list(F.struct("ix", "iy")).alias("spots"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in layer]
    met = whole.alias("a").join(spots.alias("b").hint("merge"), same).select(*[F.col(f"a.{c}").alias(c) for c in layer], "rings", "spots")
    schema = T.StructType([
        *[T.StructField(c, T.IntegerType()) for c in ("ix", "iy")], *[polygons.schema[c] for c in layer],
        *[T.StructField(f"frac_{int(r)}", T.DoubleType()) for r in radii],
    ])
    return met.mapInArrow(_overlaps(layer, radii, grid, reach), schema)


def _near_boxes(polygons: DataFrame, names: list[str], centres: DataFrame, keys: list[str], reach_m: float, cell_m: float) -> DataFrame:
    """(keys, names, longitude, latitude) of every centre within reach of a polygon's box; polygons register the cells that their boxes touch."""
    sx, sy = geo.LON_DEG_PER_M, geo.LAT_DEG_PER_M
    width, height = cell_m * sx, cell_m * sy
    box = geo.rings_bbox("rings")

    def span(low: str, high: str, margin: float, size: float) -> Column:
        low_cell, high_cell = F.floor((F.col(low) - F.lit(margin)) / F.lit(size)), F.floor((F.col(high) + F.lit(margin)) / F.lit(size))
        return F.explode(F.sequence(low_cell.cast("long"), high_cell.cast("long")))

    boxes = (
        polygons.select(*names, *[v.alias(f"__{k}") for k, v in box.items()])
        .withColumn("__cx", span("__x0", "__x1", reach_m * sx, width)).withColumn("__cy", span("__y0", "__y1", reach_m * sy, height))
    )
    placed = centres.withColumns({
        "__cx": F.floor(F.col("longitude") / F.lit(width)).cast("long"), "__cy": F.floor(F.col("latitude") / F.lit(height)).cast("long"),
    })
    return split_join(placed, boxes, ["__cx", "__cy"]).where(
        F.col("longitude").between(F.col("__x0") - F.lit(reach_m * sx), F.col("__x1") + F.lit(reach_m * sx))
        & F.col("latitude").between(F.col("__y0") - F.lit(reach_m * sy), F.col("__y1") + F.lit(reach_m * sy))
    ).select(*keys, *names, "longitude", "latitude")


def exact_shares(polygons: DataFrame, polygon_id: str, centres: DataFrame, keys: list[str],
                 radii: list[float], cell_m: float = 500.0) -> DataFrame:
    """The exact share of the disk around each centre that each polygon covers, where it is not zero.

    ``centres`` has ``keys``, longitude and latitude; disks are those of the
    grid, circles in metres at the reference latitude.  Polygons register the
    cells that their boxes touch, boxes only; rings are joined to the pairs that
    pass the box test, edge by edge, and the areas that the edges cut out of the
    circle add up.  Output columns ``share_<radius>``.
    """
    sx, sy = geo.LON_DEG_PER_M, geo.LAT_DEG_PER_M
    near = _near_boxes(polygons, [polygon_id], centres, keys, max(radii), cell_m)

    def ends(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    signed = polygons.select(polygon_id, F.posexplode(F.arrays_zip(F.col("rings").alias("ring"), geo.ring_signs("rings").alias("sign"))))
    edges = signed.select(polygon_id, F.col("pos").alias("__ring"), F.col("col.sign").alias("__sign"), F.explode(ends(F.col("col.ring"))).alias("__e"))
    met = near.hint("merge").join(edges, polygon_id)  # edges outgrow the file that the planner sizes them by
    x1, x2 = ((F.col(f"__e.{e}.x") - F.col("longitude")) / F.lit(sx) for e in "pq")
    y1, y2 = ((F.col(f"__e.{e}.y") - F.col("latitude")) / F.lit(sy) for e in "pq")
    met = met.select(*keys, polygon_id, "__ring", "__sign", x1.alias("__x1"), y1.alias("__y1"), x2.alias("__x2"), y2.alias("__y2"))
    areas = met.groupBy(*keys, polygon_id, "__ring", "__sign").agg(
        *[F.abs(F.sum(geo.edge_area_in_circle("__x1", "__y1", "__x2", "__y2", float(r)))).alias(f"a{i}") for i, r in enumerate(radii)]
    )
    shares = areas.groupBy(*keys, polygon_id).agg(
        *[F.greatest(F.lit(0.0), F.sum(F.col("__sign") * F.col(f"a{i}")) / F.lit(math.pi * r * r)).alias(f"share_{int(r)}") for i, r in enumerate(radii)]
    )
    return shares.where(F.greatest(*[F.col(f"share_{int(r)}") for r in radii], F.lit(0.0)) > 1e-12)


def layer_summary(fractions: DataFrame, layer: list[str], column: str) -> DataFrame:
    """Number of covered grid points per layer."""
    return fractions.where(F.col(column) > 1e-6).groupBy(*layer).agg(
        F.count(F.lit(1)).alias("n_cells"), F.max(column).alias("max_frac")
    )


def group_codes(fractions: DataFrame, code: str, classes: dict[str, list], keys: list[str],
                columns: list[str]) -> DataFrame:
    """Sum code fractions into classes, capped at one."""
    owner: dict[str, str] = {}
    for name, codes in classes.items():
        for c in codes:
            if str(c) in owner:
                raise ValueError(f"code {c} is in both {owner[str(c)]} and {name}")
            owner[str(c)] = name
    lookup = F.create_map(*[F.lit(v) for pair in owner.items() for v in pair])
    return (
        fractions.withColumn("class", F.try_element_at(lookup, F.col(code).cast("string")))
        .where(F.col("class").isNotNull())
        .groupBy(*keys, "class")
        .agg(*[F.least(F.lit(1.0), F.sum(c)).alias(c) for c in columns])
    )


def accuracy_report(approximate: DataFrame, truth: DataFrame, keys: list[str], column: str,
                    tol: float = 0.01, zero_tol: float = 0.005, by: list[str] | None = None) -> DataFrame:
    """Compare every zero and non-zero cell of a layer with an exact or finer result.

    ``keys`` are layer columns followed by ``ix`` and ``iy``; a missing row on
    either side is a fraction of zero.  One row for each of ``by``, the layers
    unless given, and kind.
    """
    layer = [k for k in keys if k not in ("ix", "iy")] if by is None else by
    both = approximate.select(*keys, F.col(column).alias("approx")).join(
        truth.select(*keys, F.col(column).alias("truth")), keys, "full_outer"
    ).fillna(0.0, ["approx", "truth"])
    kind = F.when(F.col("approx") > 0, F.lit("nonzero")).otherwise(F.lit("zero"))
    ok = F.when(F.col("kind") == "nonzero", F.col("err") <= tol).otherwise(
        (F.col("truth") <= zero_tol) & (F.col("approx") <= zero_tol)
    )
    return (
        both.withColumn("kind", kind)
        .withColumn("err", F.abs(F.col("approx") - F.col("truth")))
        .groupBy(*layer, "kind")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_pass"),
            F.avg("err").alias("err_mean"), F.max("err").alias("err_max"),
            F.percentile_approx("err", 0.95).alias("err_p95"),
        )
    )
