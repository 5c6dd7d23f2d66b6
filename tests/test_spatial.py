"""Spatial joins and coverage against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators import coverage, spatial
from skyloom.operators.spatial import Measure


def dist(lon1, lat1, lon2, lat2):
    north = (lat2 - lat1) * 111320.0
    east = (lon2 - lon1) * 111320.0 * np.cos(np.radians(lat1))
    return np.sqrt(north * north + east * east)


@pytest.fixture(scope="module")
def crowd():
    """Half of all points in one small spot, a third of them on one coordinate."""
    rng = np.random.default_rng(5)
    n = 3000
    lon, lat = 3.6 + rng.random(n) * 0.05, 51.0 + rng.random(n) * 0.03
    lon[:1500], lat[:1500] = 3.62 + rng.random(1500) * 0.002, 51.01 + rng.random(1500) * 0.002
    lon[:1000], lat[:1000] = 3.6201, 51.0102
    kind = np.array(["a", "b", None], dtype=object)[rng.integers(0, 3, n)]
    points = pd.DataFrame({"longitude": lon, "latitude": lat, "v": np.round(rng.random(n) * 9, 3), "kind": kind,
                           "pid": range(n), "yr": rng.integers(2000, 2004, n)})
    places = pd.DataFrame({"longitude": 3.6 + rng.random(60) * 0.05, "latitude": 51.0 + rng.random(60) * 0.03})
    places.iloc[:20, 0] = 3.62 + rng.random(20) * 0.002
    places.iloc[:20, 1] = 51.01 + rng.random(20) * 0.002
    return places, points


@pytest.mark.parametrize("leaf", [60, 100_000])
def test_radius_aggregate_matches_brute_force(spark, crowd, leaf):
    places, points = crowd
    measures = [
        Measure("n_60", "count", 60), Measure("n_300", "count", 300), Measure("avg_300", "avg", 300, "v"),
        Measure("min_60", "min", 60, "v"), Measure("max_300", "max", 300, "v"), Measure("sum_60", "sum", 60, "v"),
        Measure("a_300", "count", 300, match=(("kind", "a"),)),
    ]
    got = spatial.radius_aggregate(
        spark.createDataFrame(places), spark.createDataFrame(points), measures, leaf_points=leaf
    ).toPandas().set_index(["longitude", "latitude"])
    assert len(got) == len(places)
    for p in places.itertuples():
        d = dist(p.longitude, p.latitude, points.longitude.to_numpy(), points.latitude.to_numpy())
        row = got.loc[(p.longitude, p.latitude)]
        near, wide = points[d <= 60], points[d <= 300]
        assert row["n_60"] == len(near) and row["n_300"] == len(wide)
        assert row["a_300"] == (wide.kind == "a").sum()
        if len(wide):
            assert row["avg_300"] == pytest.approx(wide.v.mean(), rel=1e-12)
            assert row["max_300"] == wide.v.max()
        else:
            assert math.isnan(row["avg_300"])
        if len(near):
            assert row["min_60"] == near.v.min() and row["sum_60"] == pytest.approx(near.v.sum(), rel=1e-12)


def test_planted_by_counts_known_years_only(spark, crowd):
    places, points = crowd
    trees = spark.createDataFrame(points).withColumn("yr", F.when(F.col("pid") % 3 > 0, F.col("yr")))
    points = points.assign(yr=points.yr.where(points.pid % 3 > 0))
    years = places.head(10).merge(pd.DataFrame({"year": [1999, 2001, 2010]}), how="cross")
    got = spatial.planted_by(
        spark.createDataFrame(years), trees, [Measure("n", "count", 300)], "yr"
    ).toPandas()
    for row in got.itertuples():
        d = dist(row.longitude, row.latitude, points.longitude.to_numpy(), points.latitude.to_numpy())
        assert row.n == ((d <= 300) & (points.yr.fillna(9999) <= row.year)).sum()


def test_nearest_breaks_ties_by_id(spark):
    places = spark.createDataFrame([(3.7, 51.0), (3.8, 51.1)], "longitude double, latitude double")
    points = spark.createDataFrame(
        [(3.7005, 51.0, 9, "far id"), (3.6995, 51.0, 2, "low id"), (3.7005, 51.0, 1, "lowest")],
        "longitude double, latitude double, pid int, tag string",
    )
    got = {r["longitude"]: r for r in spatial.nearest(places, points, ["pid", "tag"], 500, "pid", "n_").collect()}
    assert got[3.7]["n_pid"] in (1, 2) and got[3.8]["n_pid"] is None
    d = [float(dist(3.7, 51.0, x, 51.0)) for x in (3.7005, 3.6995)]
    assert got[3.7]["n_pid"] == (1 if d[0] <= d[1] else 2)


def test_rejects_nearest_time_for_aggregates():
    from skyloom.plans.features import RadiusFeature

    with pytest.raises(ValueError):
        RadiusFeature("trees", 50, temporal="nearest")


def test_rings_with_hole_and_concave_shape(spark):
    outer = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 3.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    rings = F.array(*[F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r]) for r in (outer, hole)])
    pts = [(5.0, 1.0, True), (1.5, 1.5, False), (5.0, 8.0, False), (1.0, 7.0, True), (-1.0, 5.0, False)]
    df = spark.createDataFrame(pts, "lon double, lat double, want boolean")
    rows = df.select("want", geo.in_rings("lon", "lat", rings).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_projections_known_point(spark):
    df = spark.createDataFrame([(3.7174, 51.0543)], "longitude double, latitude double")
    r = geo.with_projection(df, geo.lambert72_steps()).first()
    assert abs(r["x_m"] - 104_330) < 30 and abs(r["y_m"] - 193_994) < 30
    # the projection centre of the equal-area grid
    c = spark.createDataFrame([(10.0, 52.0)], "longitude double, latitude double")
    r = geo.with_projection(c, geo.laea_steps()).first()
    assert abs(r["x_m"] - 4_321_000) < 1e-3 and abs(r["y_m"] - 3_210_000) < 1e-3


def test_hex_neighbours_touch(spark):
    """Six neighbours of a hexagon are one centre distance away."""
    edge = geo.HEX_EDGE_M[9]
    lon0, lat0 = 3.7, 51.05
    step = edge * math.sqrt(3)
    pts = [(lon0, lat0)] + [
        (lon0 + step * math.cos(a) * geo.LON_DEG_PER_M, lat0 + step * math.sin(a) * geo.LAT_DEG_PER_M)
        for a in [math.pi / 3 * i for i in range(6)]
    ]
    df = spark.createDataFrame(pts, "lon double, lat double")
    q, r = geo.hex_axial("lon", "lat", edge)
    rows = [(x["q"], x["r"]) for x in df.select(q.alias("q"), r.alias("r")).collect()]
    offsets = {(a - rows[0][0], b - rows[0][1]) for a, b in rows[1:]}
    assert offsets == set(geo.HEX_NEIGHBOURS)


# --- coverage --------------------------------------------------------------------------


def direct_fraction(grid, inside, ix, iy, radius):
    """Kernel-weighted share from an explicit double loop."""
    ss, sub = grid.supersample, (grid.step_lon / grid.supersample, grid.step_lat / grid.supersample)
    rad = (radius * geo.LON_DEG_PER_M, radius * geo.LAT_DEG_PER_M)
    reach = [math.ceil(r / s) + 1 for r, s in zip(rad, sub)]
    off = (np.arange(4) + 0.5) / 4 - 0.5
    total = hit = 0.0
    for dy in range(-reach[1], reach[1] + 1):
        for dx in range(-reach[0], reach[0] + 1):
            x, y = (dx + off)[None, :] * sub[0], (dy + off)[:, None] * sub[1]
            w = ((x / rad[0]) ** 2 + (y / rad[1]) ** 2 <= 1.0).mean()
            total += w
            if w and inside(grid.lon0 + (ix * ss + dx) * sub[0], grid.lat0 + (iy * ss + dy) * sub[1]):
                hit += w
    return hit / total


@pytest.mark.parametrize("ss", [1, 2, 4])
def test_disk_fraction_of_triangle_and_overlap(spark, ss):
    grid = coverage.Grid(15.0, ss)
    a = (grid.lon0 + 40.3 * grid.step_lon, grid.lat0 + 40.7 * grid.step_lat)
    b = (grid.lon0 + 55.1 * grid.step_lon, grid.lat0 + 42.2 * grid.step_lat)
    c = (grid.lon0 + 47.6 * grid.step_lon, grid.lat0 + 57.4 * grid.step_lat)
    box = (grid.lon0 + 44.2 * grid.step_lon, grid.lat0 + 44.6 * grid.step_lat,
           grid.lon0 + 49.7 * grid.step_lon, grid.lat0 + 52.3 * grid.step_lat)

    def in_triangle(x, y):
        pts, odd = [a, b, c, a], False
        for p, q in zip(pts, pts[1:]):
            if (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]:
                odd = not odd
        return odd

    def union(x, y):
        return in_triangle(x, y) or (box[0] <= x < box[2] and box[1] <= y < box[3])

    def ring(points):
        return [[{"x": x, "y": y} for x, y in points]]

    polys = spark.createDataFrame(
        [(1, "k", ring([a, b, c, a])), (2, "k", ring([box[:2], (box[2], box[1]), box[2:], (box[0], box[3]), box[:2]]))],
        "pid int, layer string, rings array<array<struct<x:double,y:double>>>",
    )
    spots = [(i, j) for i in range(38, 60, 4) for j in range(38, 60, 4)]
    targets = spark.createDataFrame(spots, "ix int, iy int")
    got = coverage.coverage(polys, ["layer"], "pid", targets, [50.0, 100.0], grid).collect()
    table = {(r["ix"], r["iy"]): (r["frac_50"], r["frac_100"]) for r in got}
    for ix, iy in spots:
        want = (direct_fraction(grid, union, ix, iy, 50.0), direct_fraction(grid, union, ix, iy, 100.0))
        assert table.get((ix, iy), (0.0, 0.0)) == pytest.approx(want, abs=1e-12)


def test_kernel_steps_rebuild_weights():
    grid = coverage.Grid(15.0, 4)
    for radius in (50.0, 70.0, 100.0):
        total = coverage.kernel_total(grid.kernel(radius)) / 16
        exact = math.pi * radius**2 / (15.0 / 4) ** 2
        assert abs(total / exact - 1) < 0.005


def test_duplicate_codes_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.5)], "code string, ix int, iy int, frac double")
    with pytest.raises(ValueError):
        coverage.group_codes(df, "code", {"x": ["a"], "y": ["a"]}, ["ix", "iy"], ["frac"])
    got = coverage.group_codes(
        spark.createDataFrame([("a", 1, 1, 0.7), ("b", 1, 1, 0.6), ("z", 1, 1, 0.2)], df.schema), "code",
        {"x": ["a", "b"]}, ["ix", "iy"], ["frac"],
    ).collect()
    assert [(r["class"], r["frac"]) for r in got] == [("x", 1.0)]


def test_supersampling_four_against_eight(spark):
    grids = [coverage.Grid(15.0, s) for s in (4, 8)]
    g = grids[0]
    ring = [[{"x": g.lon0 + x * g.step_lon, "y": g.lat0 + y * g.step_lat} for x, y in
             [(20.2, 20.4), (40.7, 22.1), (35.5, 41.9), (20.2, 20.4)]]]
    polys = spark.createDataFrame([(1, "k", ring)], "pid int, layer string, rings array<array<struct<x:double,y:double>>>")
    targets = spark.createDataFrame([(i, j) for i in range(18, 44, 5) for j in range(18, 44, 5)], "ix int, iy int")
    rough, fine = (coverage.coverage(polys, ["layer"], "pid", targets, [50.0], x) for x in grids)
    rep = coverage.accuracy_report(rough, fine, ["layer", "ix", "iy"], "frac_50", tol=0.01)
    assert all(r["n"] == r["n_pass"] for r in rep.collect())


@pytest.mark.parametrize("latitude", [0.0, 51.0, 56.0, 60.0, -70.0])
@pytest.mark.parametrize("leaf", [20, 100_000])
def test_radius_joins_at_any_latitude(spark, latitude, leaf):
    """Circles get wider in degrees towards the poles; no pair is lost."""
    rng = np.random.default_rng(int(abs(latitude)))
    wide = 0.02 / math.cos(math.radians(latitude))
    points = pd.DataFrame({"longitude": 3.7 + rng.random(400) * wide, "latitude": latitude + rng.random(400) * 0.01, "pid": range(400)})
    places = pd.DataFrame({"longitude": 3.7 + rng.random(50) * wide, "latitude": latitude + rng.random(50) * 0.01})
    left, right = spark.createDataFrame(places), spark.createDataFrame(points)
    counts = spatial.radius_aggregate(left, right, [Measure("n", "count", 150)], leaf_points=leaf).toPandas()
    hits = spatial.nearest(left, right, ["pid"], 150, "pid").toPandas().set_index(["longitude", "latitude"])
    assert len(counts) == len(hits) == 50
    for p in counts.itertuples():
        d = dist(p.longitude, p.latitude, points.longitude.to_numpy(), points.latitude.to_numpy())
        assert p.n == (d <= 150).sum()
        found = hits.loc[(p.longitude, p.latitude)]["pid"]
        assert (found == d.argmin()) if d.min() <= 150 else math.isnan(found)
