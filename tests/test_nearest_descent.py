"""Nearest in space and in time by bounded descent against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import spatial
from test_spatial import dist


def crowd(rng, n, spread=0.004):
    """Points of which half share spots or times, most of them in one search cell."""
    lon, lat = 3.62 + rng.random(n) * spread, 51.01 + rng.random(n) * spread
    lon[: n // 4], lat[: n // 4] = 3.6213, 51.0121
    lon[n // 4 : n // 2] = 3.6215 + rng.integers(0, 5, n // 2 - n // 4) * 1e-4
    days = rng.integers(0, 400, n)
    days[rng.random(n) < 0.3] = 100
    return pd.DataFrame({"longitude": lon, "latitude": lat, "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(days, "D"), "pid": rng.permutation(n)})


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    points = crowd(rng, 4000)
    places = crowd(rng, 150, 0.012)
    places["longitude"] -= 0.003
    return places.drop(columns="pid").drop_duplicates(), points


def test_nearest(spark, data, monkeypatch):
    monkeypatch.setattr(spatial, "OPEN_POINTS", 4)
    places, points = data
    at = places[["longitude", "latitude"]].drop_duplicates()
    got = spatial.nearest(spark.createDataFrame(at), spark.createDataFrame(points), ["pid"], 300, "pid").toPandas()
    got = got.set_index(["longitude", "latitude"])
    assert len(got) == len(at)
    for p in at.itertuples():
        d = dist(p.longitude, p.latitude, points.longitude.to_numpy(), points.latitude.to_numpy())
        row, near = got.loc[(p.longitude, p.latitude)], d <= 300
        if near.any():
            assert row["pid"] == points.pid[d == d.min()].min() and row["dist_m"] == pytest.approx(d.min(), abs=1e-9)
        else:
            assert np.isnan(row["pid"])


@pytest.mark.parametrize("temporal", ["last_previous", "nearest"])
@pytest.mark.parametrize("radius", [40, 300])
def test_as_of(spark, data, temporal, radius):
    places, points = data
    early = places.iloc[:1].assign(ts=pd.Series([pd.Timestamp("2019-01-01")], index=places.index[:1]).astype(places["ts"].dtype))
    places = pd.concat([places, early])
    got = spatial.nearest_as_of(
        spark.createDataFrame(places), spark.createDataFrame(points), ["pid"], radius, "pid", temporal, prefix="hit_"
    ).toPandas().set_index(["longitude", "latitude", "ts"])
    assert len(got) == len(places)
    for p in places.itertuples():
        d = dist(p.longitude, p.latitude, points.longitude.to_numpy(), points.latitude.to_numpy())
        gap = (p.ts - points.ts).dt.total_seconds().to_numpy()
        fits = (d <= radius) & ((gap >= 0) | (temporal == "nearest"))
        row = got.loc[(p.longitude, p.latitude, p.ts)]
        row = row if isinstance(row, pd.Series) else row.iloc[0]
        if fits.any():
            best = min(zip(np.abs(gap[fits]), d[fits], points.pid[fits]))
            assert row["hit_pid"] == best[2] and row["hit_dist_m"] == pytest.approx(best[1], abs=1e-9)
        else:
            assert np.isnan(row["hit_pid"])


@pytest.mark.parametrize("shape", ["even", "spot", "apart"])
def test_pairs_stay_few(spark, shape):
    """A search cell with 20,000 points and 20,000 locations: less than 1 % of the pairs are formed."""
    n = 20_000
    x, y = F.rand(1), F.rand(2)
    small = 1e-5 if shape == "spot" else 1e-3
    points = spark.range(n).select((3.6 + x * small).alias("longitude"), (51.0 + y * small).alias("latitude"), F.col("id").alias("pid")).cache()
    away = 3e-3 if shape == "apart" else 0.0
    rows = spark.range(n).select((3.6 + away + F.rand(3) * 1e-3).alias("longitude"), (51.0 + F.rand(4) * 1e-3).alias("latitude")).cache()
    pairs = spatial.descended_pairs(rows, points, 500)
    assert pairs.count() < n * n / 100
    assert pairs.select("longitude", "latitude").distinct().count() == n


def test_timed_pairs_stay_few(spark):
    n = 4000
    points = spark.range(n).select((3.6 + F.rand(1) * 3e-3).alias("longitude"), (51.0 + F.rand(2) * 3e-3).alias("latitude"), (F.rand(5) * 1e15).cast("long").alias("__pt")).cache()
    rows = spark.range(n).select((3.6 + F.rand(3) * 3e-3).alias("longitude"), (51.0 + F.rand(4) * 3e-3).alias("latitude"), (F.rand(6) * 1e15).cast("long").alias("__t")).cache()
    for temporal in ("last_previous", "nearest"):
        assert spatial.descended_pairs(rows, points, 500, temporal, 4).count() < n * n / 100
