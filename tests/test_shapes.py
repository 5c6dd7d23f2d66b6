"""Hulls, simplified hulls and least rectangles against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import derive
from skyloom.operators import shapes


def area(x, y):
    return 0.5 * float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def inside(x, y, px, py):
    """Smallest turn of any point from any edge."""
    dx, dy = np.roll(x, -1) - x, np.roll(y, -1) - y
    return (dx[:, None] * (py[None, :] - y[:, None]) - dy[:, None] * (px[None, :] - x[:, None])).min()


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(6)
    parts = [rng.normal(size=(500, 2)), np.round(rng.random((400, 2)) * 5), np.array([[1.0, 1.0]] * 3), np.array([[i, 2.0 * i] for i in range(9)])]
    angle = rng.random(300) * 2 * math.pi
    parts.append(np.column_stack([np.cos(angle), np.sin(angle)]))
    return pd.concat([pd.DataFrame({"g": f"g{i}" if i else None, "x": p[:, 0], "y": p[:, 1]}) for i, p in enumerate(parts)])


def test_hulls(spark, cloud):
    df = spark.createDataFrame(cloud).union(spark.createDataFrame([("g1", None, 1.0), ("g1", float("nan"), 9.0)], "g string, x double, y double"))
    got = {r["g"]: r["ring"] for r in shapes.convex_hulls(df.repartition(9), ["g"], "x", "y").collect()}
    assert len(got) == 5
    for g, own in cloud.groupby("g", dropna=False):
        ring = got[g if isinstance(g, str) else None]
        x, y = (np.array([p[c] for p in ring[:-1]]) for c in "xy")
        assert ring[0] == ring[-1] and len(set(zip(x, y))) == len(x)
        px, py = own["x"].to_numpy(), own["y"].to_numpy()
        assert set(zip(x, y)) <= set(zip(px, py))
        if len(x) > 2:
            assert inside(x, y, px, py) >= -1e-12
            dx, dy = np.roll(x, -1) - x, np.roll(y, -1) - y
            assert (dx * np.roll(dy, -1) - dy * np.roll(dx, -1) > 0).all()  # every corner turns left
    assert len(got["g2"]) == 2 and len(got["g3"]) == 3 and len(got["g4"]) == 301
    assert shapes.convex_hulls(df.limit(0), ["g"], "x", "y").count() == 0


@pytest.mark.parametrize("corners", [3, 4, 7])
def test_few_corners_hold_the_hull(corners):
    rng = np.random.default_rng(corners)
    for _ in range(20):
        x, y = shapes.hull_corners(rng.normal(size=60), rng.normal(size=60) * 3)
        fx, fy = shapes.fewer_corners(x, y, corners)
        assert len(fx) <= max(corners, 4) and inside(fx, fy, x, y) >= -1e-9
        assert area(fx, fy) >= area(x, y) - 1e-9


def test_least_rectangle():
    turn = 0.7
    x, y = np.array([0, 4, 4, 0, 2.0]), np.array([0, 0, 1, 1, 0.5])
    found = shapes.least_rectangle(*shapes.hull_corners(x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)))
    assert found == pytest.approx((4.0, 4.0, 1.0))
    rng = np.random.default_rng(1)
    hx, hy = shapes.hull_corners(rng.normal(size=80), rng.normal(size=80))
    angles = np.linspace(0, math.pi / 2, 20_000)
    u, v = hx[None] * np.cos(angles)[:, None] + hy[None] * np.sin(angles)[:, None], hy[None] * np.cos(angles)[:, None] - hx[None] * np.sin(angles)[:, None]
    tried = ((u.max(1) - u.min(1)) * (v.max(1) - v.min(1))).min()
    assert shapes.least_rectangle(hx, hy)[0] <= tried + 1e-9 and tried <= shapes.least_rectangle(hx, hy)[0] * 1.001
    assert shapes.least_rectangle(np.array([0.0, 3.0]), np.array([0.0, 4.0])) == (0.0, 5.0, 0.0)


def test_genus_of_odd_letters(spark):
    rows = [("Ａｃｅｒ　campestre", "Acer"), ("Tiﬀlia x", "Tifflia"), ("Quercus robur", "Quercus"), (None, None)]
    df = spark.createDataFrame(rows, "name string, want string")
    assert df.where(~derive.genus(F.col("name")).eqNullSafe(F.col("want"))).count() == 0
