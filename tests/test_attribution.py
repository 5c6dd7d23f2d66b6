"""Shapley values of trees against enumeration over all coalitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import models
from skyloom.operators.attribution import Tree, attribution_summary, base_value, saved_trees, shapley_values, tree_attribution


def grown(rng, features, depth):
    """A random tree whose features repeat along paths."""
    nodes = []

    def grow(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == depth or cover < 4 or rng.random() < 0.1:
            nodes[at] = (-1, 0.0, -1, -1, rng.normal(), cover)
            return at
        share = rng.uniform(0.1, 0.9)
        left = grow(level + 1, cover * share)
        right = grow(level + 1, cover * (1 - share))
        nodes[at] = (int(rng.integers(features)), rng.normal(), left, right, 0.0, cover)
        return at

    grow(0, 1000.0)
    return Tree(*map(np.array, zip(*nodes)), weight=float(rng.uniform(0.5, 2)))


def expected(tree, row, known, node=0):
    """The tree's value for a row of which only ``known`` features are given."""
    if tree.left[node] < 0:
        return tree.value[node]
    f, left, right = tree.feature[node], tree.left[node], tree.right[node]
    if f in known:
        return expected(tree, row, known, left if row[f] <= tree.cut[node] else right)
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, row, known, c) for c in (left, right))


def enumerated(tree, row, features):
    out = []
    for f in range(features):
        rest = [g for g in range(features) if g != f]
        total = 0.0
        for k in range(features):
            weight = math.factorial(k) * math.factorial(features - k - 1) / math.factorial(features)
            for known in itertools.combinations(rest, k):
                total += weight * (expected(tree, row, {*known, f}) - expected(tree, row, set(known)))
        out.append(tree.weight * total)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    features, depth = 2 + seed % 4, 1 + seed
    trees = [grown(rng, features, depth) for _ in range(3)]
    x = rng.normal(size=(25, features))
    got = shapley_values(trees, x)
    want = [sum(np.array(enumerated(t, row, features)) for t in trees) for row in x]
    assert np.allclose(got, want, atol=1e-10)
    assert np.allclose(base_value(trees) + got.sum(1), sum(t.weight * t.predict(x) for t in trees))


@pytest.mark.parametrize("kind, settings", [("random_forest", {"numTrees": 5, "maxDepth": 5}), ("boosting", {"maxIter": 5, "maxDepth": 4})])
def test_adds_up_to_the_model(spark, kind, settings):
    df = spark.range(3000).select(
        "id", (F.rand(1) * 10).alias("a"), F.rand(2).alias("b.c"), (F.col("id") % 7).alias("d"), F.lit(None).cast("double").alias("base")
    )
    df = df.withColumn("y", F.col("a") * F.col("`b.c`") + F.col("d")).drop("base").cache()
    names = ["a", "d"]
    model = models.fit_model(kind, df, names, "y", **settings)
    scored = models.predict(model, df)
    out = tree_attribution(scored, saved_trees(model, spark), names)
    gap = out.agg(F.max(F.abs(F.col("base") + F.col("a_effect") + F.col("d_effect") - F.col("prediction")))).first()[0]
    assert gap < 1e-9 and out.count() == 3000
    summary = attribution_summary(out, names).collect()
    assert {r["feature"] for r in summary} == {"a", "d"} and summary[0]["mean_abs_effect"] >= summary[1]["mean_abs_effect"] > 0
    assert tree_attribution(df.limit(0), saved_trees(model, spark), names).count() == 0
