"""Shapley values of tree ensembles, path dependent, for every row.

A tree is an array of nodes with split, children, mean and number of training
rows.  A feature that is left out of a coalition sends a row down both
branches, weighted by the training rows that went there.  For one leaf with
value v the Shapley value of a feature on its path is then

    v (o - z) * integral over t of the product over the path's other features of (t o + (1 - t) z)

with o = 1 if the row passes the feature's splits on the path (else 0) and z
the share of training rows that pass them.  The integrand is a polynomial, so a
Gauss-Legendre rule of half as many nodes as the path has features is exact.
Products go down the tree and sums over leaves come back up, so each edge is
visited once for a whole batch of rows; a feature that splits again below
replaces its factor there.

Values and base add up to the prediction.  The nodes of a model are bounded by
its own settings (trees times two to the depth), whatever the data's size; they
go to every task, and rows are explained where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.session import new_table_path

#: Rows that one sweep over a tree takes.
_ROWS = 4096


@dataclass(frozen=True)
class Tree:
    """Node arrays, the root first; ``left`` and ``right`` are -1 in leaves, rows with a value up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: float = 1.0

    def mean(self) -> float:
        """What the tree predicts when every feature is left out."""
        leaves = self.left < 0
        return float((self.value[leaves] * self.cover[leaves]).sum() / self.cover[leaves].sum())

    def depth(self) -> int:
        level, at = 0, np.array([0])
        while True:
            at = at[self.left[at] >= 0]
            if not len(at):
                return level
            level, at = level + 1, np.concatenate([self.left[at], self.right[at]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return self.value[at]
            here = at[inner]
            low = x[inner, self.feature[here]] <= self.cut[here]
            at[inner] = np.where(low, self.left[here], self.right[here])


def saved_trees(model, spark) -> list[Tree]:
    """The trees of a fitted forest, boosted or single-tree regression, read from the model's own table of nodes.

    Forests average their trees; boosted models weigh them.  A node's cover is
    the weight of its training rows, where one stands for several.
    """
    model = getattr(model, "model", model)
    path = new_table_path(spark, "model")
    model.write().overwrite().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
    else:
        table = table.withColumn("treeID", F.lit(0))
    split = {"feature": F.col("split.featureIndex"), "cut": F.get("split.leftCategoriesOrThreshold", F.lit(0)), "categories": F.col("split.numCategories")}
    cover = F.get("impurityStats", F.lit(0)).alias("cover")
    nodes = table.select("treeID", "id", "leftChild", "rightChild", "prediction", cover, *[c.alias(n) for n, c in split.items()])
    frame = nodes.orderBy("treeID", "id").toPandas()  # bounded by trees and depth
    inner = frame["leftChild"] >= 0
    if (frame.loc[inner, "categories"] >= 0).any():
        raise ValueError("categorical splits are not supported")
    weights = list(getattr(model, "treeWeights", [1.0]))
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    trees = []
    for (_, own), weight in zip(frame.groupby("treeID", sort=True), weights):
        own = own.sort_values("id")
        trees.append(
            Tree(
                own["feature"].to_numpy(np.int64), own["cut"].fillna(0.0).to_numpy(float), own["leftChild"].to_numpy(np.int64),
                own["rightChild"].to_numpy(np.int64), own["prediction"].to_numpy(float), own["cover"].to_numpy(float), float(weight),
            )
        )
    return trees


def base_value(trees: Sequence[Tree]) -> float:
    return sum(t.weight * t.mean() for t in trees)


def _add_tree(tree: Tree, x: np.ndarray, out: np.ndarray) -> None:
    """Add the tree's values for the rows of ``x`` to ``out``, one column a feature."""
    points, rule = np.polynomial.legendre.leggauss(max(1, -(-tree.depth() // 2)))
    t, w = ((points + 1) / 2)[:, None], (rule / 2)[:, None]

    def factor(passed: np.ndarray | float, share: float) -> np.ndarray:
        return t * passed + (1 - t) * share

    def below(node: int, product: np.ndarray, known: dict[int, tuple[np.ndarray, float]]) -> np.ndarray:
        """Sum over the leaves under ``node`` of value times product, at every point and row."""
        if tree.left[node] < 0:
            return tree.value[node] * product
        feature = int(tree.feature[node])
        low = x[:, feature] <= tree.cut[node]
        total = np.zeros_like(product)
        before = known.get(feature)
        for child, goes in ((int(tree.left[node]), low), (int(tree.right[node]), ~low)):
            share = tree.cover[child] / tree.cover[node]
            if share == 0:
                continue  # no training row, no weight in any coalition that leaves the feature out, and none came here
            passed = goes.astype(float)
            down = product
            if before is not None:
                passed, share = passed * before[0], share * before[1]
                down = product / factor(before[0], before[1])
            here = factor(passed, share)
            leaves = below(child, down * here, {**known, feature: (passed, share)})
            total += leaves
            out[:, feature] += tree.weight * (passed - share) * (w * leaves / here).sum(0)
            if before is not None:
                # leaves under a second split of the feature are not the first one's
                out[:, feature] -= tree.weight * (before[0] - before[1]) * (w * leaves / factor(*before)).sum(0)
        return total

    below(0, np.ones((len(t), len(x))), {})


def shapley_values(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """Rows by features."""
    out = np.zeros(x.shape)
    for at in range(0, len(x), _ROWS):
        for tree in trees:
            _add_tree(tree, x[at : at + _ROWS], out[at : at + _ROWS])
    return out


def tree_attribution(df: DataFrame, trees: Sequence[Tree], features: Sequence[str], suffix: str = "_effect") -> DataFrame:
    """``df`` with ``base`` and for each feature its Shapley value; together they are the ensemble's prediction."""
    trees = list(trees)

    @F.pandas_udf("array<double>")
    def explain(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(features)))
        return pd.Series(list(shapley_values(trees, x.astype(float))))

    values = explain(F.array(*[F.col(f"`{f}`").cast("double") for f in features]))
    named: dict[str, Column] = {f"{f}{suffix}": F.col("__effects")[i] for i, f in enumerate(features)}
    return df.withColumn("__effects", values).withColumns(named).withColumn("base", F.lit(base_value(trees))).drop("__effects")


def attribution_summary(explained: DataFrame, features: Sequence[str], suffix: str = "_effect") -> DataFrame:
    """Mean absolute value of each feature, greatest first."""
    means = explained.agg(*[F.avg(F.abs(f"{f}{suffix}")).alias(f) for f in features])
    return means.unpivot([], list(features), "feature", "mean_abs_effect").orderBy(F.desc("mean_abs_effect"))
