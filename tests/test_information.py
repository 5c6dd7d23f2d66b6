"""Neighbour-based mutual information, and block statistics, against plain computation."""

import math

import numpy as np
import pandas as pd
import pytest

from skyloom.operators import association, information, ranks


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    reach = np.nextafter(np.sort(d, 1)[:, k - 1], 0)
    total = 0.0
    for own in (dx, dy):
        total += np.mean([psi(int(c)) for c in (own <= reach[:, None]).sum(1)])
    return max(0.0, psi(len(x)) + psi(k) - total)


@pytest.mark.parametrize("tile", [40, 2000])
@pytest.mark.parametrize("kind", ["smooth", "ties", "clusters"])
def test_neighbour_information(spark, monkeypatch, tile, kind):
    monkeypatch.setattr(information, "TILE", tile)
    rng = np.random.default_rng(7)
    n = 900
    x = rng.normal(size=n)
    y = x * 0.8 + rng.normal(size=n)
    if kind == "ties":
        x, y = np.round(x * 3), np.round(y, 1)
        x[:300] = 0
        y[:200] = 0
    if kind == "clusters":
        x = np.where(rng.random(n) < 0.5, x * 1e-6, 1e3 + x)
        x[0], y[0] = 1e6, -50
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert information.neighbour_information(df, "x", "y") == pytest.approx(plain(x, y), abs=1e-10)


def test_neighbour_information_of_little(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (2.0, float("nan")), (1.0, 3.0), (1.0, 2.0), (1.0, 5.0)], "x double, y double")
    assert information.neighbour_information(df, "x", "y", 3) == 0.0  # x does not vary
    assert information.neighbour_information(df, "x", "y", 4) is None
    assert information.neighbour_information(df.limit(0), "x", "y") is None


def test_digamma(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 400).select("id", information.digamma(F.col("id")).alias("d")).collect()
    assert all(r["d"] == pytest.approx(psi(r["id"]), abs=1e-11) for r in rows)


def average_ranks(v):
    return pd.Series(v).rank().to_numpy()


def counted(x, y, bins=10):
    cuts = [np.quantile(v, [i / bins for i in range(1, bins)]) for v in (x, y)]
    table = np.zeros((bins, bins))
    np.add.at(table, tuple((c[None, :] <= v[:, None]).sum(1) for c, v in zip(cuts, (x, y))), 1)
    return association.information(table)


def test_blocks_of_many_features(spark):
    """Rank correlation and information of every pair of a block from one pass each, equal to pair by pair."""
    rng = np.random.default_rng(2)
    n = 700
    frame = pd.DataFrame({f"trees_a{i}": np.round(rng.normal(size=n), i) for i in range(3)} | {f"dhm_b{i}": rng.gamma(1, size=n) for i in range(4)})
    frame.loc[:400, "dhm_b0"] = 0.0
    frame["dhm_b1"] += frame["trees_a2"]
    frame.loc[rng.random(n) < 0.05, "trees_a1"] = np.nan
    got = association.cross_correlations(spark.createDataFrame(frame), list(frame.columns)).toPandas()
    assert len(got) == 12
    rows = frame.dropna()
    for r in got.itertuples():
        a, b = rows[r.feature_a].to_numpy(), rows[r.feature_b].to_numpy()
        assert r.n_valid == len(rows) and r.pearson_r == pytest.approx(np.corrcoef(a, b)[0, 1])
        assert r.spearman_r == pytest.approx(np.corrcoef(average_ranks(a), average_ranks(b))[0, 1])
        assert r.mi == pytest.approx(counted(a, b))


def test_jobs_do_not_grow_with_pairs(spark):
    rng = np.random.default_rng(2)

    def jobs(n):
        frame = pd.DataFrame({f"{g}_{i}": rng.random(300) for g in ("trees", "dhm") for i in range(n)})
        df = spark.createDataFrame(frame).cache()
        df.count()
        group = f"pairs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        association.cross_correlations(df, list(frame.columns)).collect()
        association.spearman_pairs(df, [(f"trees_{i}", f"dhm_{i}") for i in range(n)])
        done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done

    assert jobs(4) <= jobs(1) + 2


def test_column_quantiles(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": rng.normal(size=501), "b.c": np.round(rng.random(501) * 4), "none": np.nan})
    frame.loc[3:30, "a"] = np.nan
    got = ranks.column_quantiles(spark.createDataFrame(frame), list(frame.columns), [0.0, 0.3, 0.5, 1.0])
    assert got["none"] == [None] * 4
    for c in ("a", "b.c"):
        assert got[c] == pytest.approx(np.nanquantile(frame[c], [0.0, 0.3, 0.5, 1.0]))
    assert math.isfinite(got["a"][0]) and ranks.column_quantiles(spark.createDataFrame(frame), [], [0.5]) == {}


@pytest.mark.parametrize("kind", ["distinct", "ties", "line", "few"])
def test_queries_look_around_themselves(kind):
    """The nearest of a tile without the distances of all its pairs, also where values repeat."""
    import tracemalloc

    rng = np.random.default_rng(1)
    px, py = (rng.random(2 if kind == "few" else 2000) for _ in "xy")
    if kind == "ties":
        px, py = np.round(px * 20), np.round(py * 300)
    if kind == "line":
        px = np.repeat(0.5, len(px))
    at = rng.integers(0, len(px), 1500)
    qx, qy = px[at] + rng.random(1500) * 0.3, py[at] - rng.random(1500) * 0.1
    d = np.sort(np.maximum(np.abs(qx[:, None] - px), np.abs(qy[:, None] - py)), axis=1)[:, :3]
    want = np.full((1500, 3), np.inf)
    want[:, : d.shape[1]] = d
    tracemalloc.start()
    got = information._nearest(px, py, qx, qy, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and peak < 8_000_000
