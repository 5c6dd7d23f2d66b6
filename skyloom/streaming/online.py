"""Linear models learned from a stream, with their error before learning.

A micro-batch is first scored by the model of the batch before it, which gives
an honest running error, and then learned from.  What is learned are sums of
products: the model after a batch is the exact solution for all rows so far,
or for fading memory when older batches are weighed down, and a batch costs one
pass.  Every batch writes its own version (error, sums, coefficients) under its
number and reads only the version of the number before, so a batch that runs
twice changes nothing, and any version can be read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.operators.gram import gram_by, square
from skyloom.operators.ranks import number
from skyloom.session import materialise

VERSION = (
    "n long, sse double, sae double, sum_error double, sum_y double, sum_yy double, weight double, products array<double>, coefficients array<double>"
)


@dataclass(frozen=True)
class Online:
    """``alpha`` penalises a row; ``l1_share`` of it on absolute sizes; ``keep`` weighs earlier batches; ``epsilon`` bounds residuals."""

    alpha: float = 0.0
    l1_share: float = 0.0
    keep: float = 1.0
    epsilon: float | None = None


def solve_penalised(products: np.ndarray, weight: float, s: Online, sweeps: int = 1000) -> np.ndarray:
    """Intercept and coefficients from X'X over [1, features, target]: ridge at once, with absolute penalties by coordinate descent."""
    p = len(products) - 1
    a, b = products[:p, :p], products[:p, p]
    penalty = np.full(p, s.alpha * weight)
    penalty[0] = 0.0
    l1, l2 = penalty * s.l1_share, penalty * (1 - s.l1_share)
    if not l1.any():
        return np.linalg.lstsq(a + np.diag(l2), b, rcond=None)[0]
    beta = np.zeros(p)
    for _ in range(sweeps):
        before = beta.copy()
        for j in range(p):
            if a[j, j] + l2[j] > 0:
                rest = b[j] - a[j] @ beta + a[j, j] * beta[j]
                beta[j] = np.sign(rest) * max(abs(rest) - l1[j], 0.0) / (a[j, j] + l2[j])
        if np.abs(beta - before).max() < 1e-12 * max(1.0, np.abs(beta).max()):
            break
    return beta


def linear_score(coefficients: Sequence[float], features: Sequence[str]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, f in zip(coefficients[1:], features):
        out = out + F.lit(float(c)) * number(f)
    return out


def online_partial(features: Sequence[str], target: str, path: str, settings: Online = Online()) -> Callable[[DataFrame, int], DataFrame]:
    """The step of one batch, for ``jobs.run_partials`` over the same ``path``; rows with a missing value are passed over."""
    features = list(features)

    def partial(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/rows/batch={batch_id - 1}").first() if batch_id else None
        names = [f"x{i}" for i in range(len(features))]
        rows = batch.select(*[number(f).alias(n) for f, n in zip(features, names)], number(target).alias("y")).dropna()
        known = old is not None and old["coefficients"] is not None
        error = (linear_score(old["coefficients"], names) if known else F.lit(None).cast("double")) - F.col("y")
        weight = F.lit(1.0)
        if known and settings.epsilon is not None:
            weight = F.least(F.lit(1.0), F.lit(settings.epsilon) / F.greatest(F.abs("error"), F.lit(1e-300)))
        rows = materialise(rows.withColumn("error", error).withColumn("root", F.sqrt(weight)), "online")
        sums = rows.agg(
            F.count("error").alias("n"), F.sum(F.col("error") * F.col("error")).alias("sse"), F.sum(F.abs("error")).alias("sae"), F.sum("error").alias("sum_error"),
            F.sum(F.when(F.col("error").isNotNull(), F.col("y"))).alias("sum_y"), F.sum(F.when(F.col("error").isNotNull(), F.col("y") * F.col("y"))).alias("sum_yy"),
        ).first()
        design = ["root", *names, "y"]
        weighed = rows.select("root", *[(F.col(c) * F.col("root")).alias(c) for c in [*names, "y"]])
        own = gram_by(weighed, design).first()
        size = len(design)
        products = square(own["products"], size) if own and own["n"] else np.zeros((size, size))
        if old is not None:
            products = products + settings.keep * square(old["products"], size)
        total = float(products[0, 0])
        found = solve_penalised(products, total, settings).tolist() if total else None
        upper = products[np.triu_indices(size)].tolist()
        moments = [float(sums[c] or 0.0) for c in ("sse", "sae", "sum_error", "sum_y", "sum_yy")]
        return spark.createDataFrame([(sums["n"], *moments, total, upper, found)], VERSION)

    return partial


def error_history(versions: DataFrame) -> DataFrame:
    """For every batch the error of the model before it, of the batch alone and of all rows so far."""
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row a batch
    total = {c: F.sum(c).over(so_far) for c in ("n", "sse", "sae")}
    return versions.select(
        "batch", "n", F.sqrt(F.try_divide("sse", "n")).alias("rmse"), F.try_divide("sae", F.col("n")).alias("mae"), F.try_divide("sum_error", F.col("n")).alias("bias"),
        F.sqrt(F.try_divide(total["sse"], total["n"])).alias("running_rmse"), F.try_divide(total["sae"], total["n"]).alias("running_mae"),
    )


def model_of(spark: SparkSession, path: str, batch: int) -> list[float]:
    """Intercept and coefficients after a batch."""
    return list(spark.read.parquet(f"{path}/rows/batch={batch}").first()["coefficients"])
