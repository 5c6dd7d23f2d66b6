"""Boosted and extremely randomised trees against plain Python and the library's own models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import models, trees
from skyloom.operators.attribution import tree_attribution
from skyloom.operators.trees import Boosting, Ensemble, RandomTrees, fit_boosted, fit_random_trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 2500
    x = rng.normal(size=(n, 3))
    x[:, 2] = rng.integers(0, 4, n)
    y = np.where(x[:, 0] > 0.3, x[:, 1] * 2, x[:, 2]) + rng.normal(size=n) * 0.1
    frame = pd.DataFrame({"a": x[:, 0], "b.c": x[:, 1], "d": x[:, 2], "y": y, "valid": 0.0, "key": "text"})
    return frame, spark.createDataFrame(frame).cache()


NAMES = ["a", "d"]


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]


def test_boosting_matches_the_library(data):
    _, df = data
    df = df.withColumnRenamed("b.c", "b")
    names = ["a", "b", "d"]
    ours = fit_boosted(df, names, "y", Boosting(rounds=8, depth=3, rate=0.3, row_share=1.0, column_share=1.0))
    theirs = models.fit_model("boosting", df, names, "y", maxIter=8, maxDepth=3, stepSize=0.3)
    assert rmse(ours.transform(df)) <= rmse(models.predict(theirs, df)) * 1.02
    assert sum(ours.importance().values()) == pytest.approx(1) and min(ours.importance().values()) > 0
    total = F.col("base") + sum(F.col(f"{n}_effect") for n in names) + F.lit(ours.base)
    gap = tree_attribution(ours.transform(df), ours.trees, names).agg(F.max(F.abs(total - F.col("prediction")))).first()[0]
    assert gap < 1e-9


def plain_boosted(frame, names, s, cuts, base, sampled):
    """Margins after the same rounds, split by split over all rows."""
    x = np.stack([np.searchsorted(c, frame[n]) for c, n in zip(cuts, names)], 1)
    y, margin = frame["y"].to_numpy(), np.full(len(frame), base)

    def grow(rows, level, columns, at):
        g, h = (margin - y)[rows].sum(), float(len(rows))
        best = (0.0, None, None)
        if level < s.depth:
            for f in columns:
                for b in range(s.bins - 1):
                    left = rows[x[rows, f] <= b]
                    if len(left) < s.child_weight or len(rows) - len(left) < s.child_weight:
                        continue
                    gl = (margin - y)[left].sum()
                    gain = (gl**2 / (len(left) + s.l2) + (g - gl) ** 2 / (h - len(left) + s.l2) - g**2 / (h + s.l2)) / 2 - s.least_gain
                    if gain > best[0] + 1e-9:
                        best = (gain, f, b)
        if best[1] is None:
            out[at] = -g / (h + s.l2) * s.rate
            return
        _, f, b = best
        grow(rows[x[rows, f] <= b], level + 1, columns, at[x[at, f] <= b])
        grow(rows[x[rows, f] > b], level + 1, columns, at[x[at, f] > b])

    for t in range(s.rounds):
        out = np.zeros(len(frame))
        grow(np.flatnonzero(sampled(t)), 0, trees._columns(len(names), t, s), np.arange(len(frame)))
        margin = margin + out
    return margin


def test_boosting_equals_plain_python(spark, data):
    frame, df = data
    s = Boosting(rounds=3, depth=3, bins=16, row_share=0.7, column_share=0.6, child_weight=20, least_gain=0.5)
    model = fit_boosted(df, NAMES, "y", s)
    keyed = df.select(*NAMES, "y", F.xxhash64(*[F.col(c).cast("double") for c in NAMES], "y").alias("k")).toPandas()
    want = plain_boosted(keyed, NAMES, s, model.cuts, model.base, lambda t: trees._sampled(keyed["k"].to_numpy(), t, s))
    got = model.transform(spark.createDataFrame(keyed)).toPandas()
    assert np.allclose(got["prediction"], want)


def test_going_on_equals_fitting_in_one_go(spark, data, tmp_path):
    _, df = data
    half, whole = Boosting(rounds=2, depth=3), Boosting(rounds=4, depth=3)
    first = fit_boosted(df, NAMES, "y", half)
    first.save(spark, str(tmp_path))
    second = fit_boosted(df, NAMES, "y", half, start=Ensemble.load(spark, str(tmp_path)))
    at_once = fit_boosted(df, NAMES, "y", whole)
    assert len(second.trees) == 4
    for a, b in zip(second.trees, at_once.trees):
        assert (a.feature == b.feature).all() and np.allclose(a.cut, b.cut) and np.allclose(a.value, b.value)


def test_early_stopping(spark, data):
    _, df = data
    noise = df.withColumn("y", F.randn(5))
    model = fit_boosted(noise, NAMES, "y", Boosting(rounds=12, depth=4, rate=0.8, patience=2), valid=noise.withColumn("y", F.randn(6)))
    errors = [e for _, e in model.history]
    assert len(model.trees) < 12 and len(errors) == len(model.trees) and errors[-1] == min(errors)


def test_missing_values_and_empty_rows(spark):
    rows = [(1.0, 2.0), (None, 3.0), (float("nan"), 4.0), (5.0, None), (6.0, 7.0)] * 5
    df = spark.createDataFrame(rows, "a double, y double")
    for model in (fit_boosted(df, ["a"], "y", Boosting(rounds=1, depth=1)), fit_random_trees(df, ["a"], "y", RandomTrees(trees=2, depth=2, leaf_rows=1))):
        assert model.transform(df).where("prediction is null").count() == 0
        assert model.transform(df.limit(0)).count() == 0


def plain_random_trees(frame, names, s, base):
    x, y = frame[names].to_numpy(float), frame["y"].to_numpy() - base
    out = np.full(len(frame), base)
    for t in range(s.trees):
        waiting, following, made = [(0, np.arange(len(x)))], [], 1
        for level in range(s.depth + 1):
            for node, rows in waiting:
                own = y[rows]
                best = (1e-12 * max(1.0, (own**2).sum()), None)
                draws = trees._draws(t, node, len(names), s)
                for f in range(len(names)):
                    low, high = x[rows, f].min(), x[rows, f].max()
                    cut = low + draws[f] * (high - low)
                    left = x[rows, f] <= cut
                    if level < s.depth and high > low and not np.isnan(cut) and min(left.sum(), (~left).sum()) >= s.leaf_rows:
                        gain = own[left].sum() ** 2 / left.sum() + own[~left].sum() ** 2 / (~left).sum() - own.sum() ** 2 / len(own)
                        if gain > best[0]:
                            best = (gain, left)
                if best[1] is None:
                    out[rows] += own.mean() / s.trees
                else:
                    following += [(made, rows[best[1]]), (made + 1, rows[~best[1]])]
                    made += 2
            waiting, following = following, []
    return out


def test_random_trees_equal_plain_python(spark, data):
    frame, df = data
    s = RandomTrees(trees=4, depth=4, leaf_rows=30, column_share=0.5)
    model = fit_random_trees(df, NAMES, "y", s)
    got = model.transform(df).select(*NAMES, "y", "prediction").toPandas()
    assert np.allclose(got["prediction"], plain_random_trees(got, NAMES, s, model.base))
    assert rmse(model.transform(df)) < frame["y"].std()
